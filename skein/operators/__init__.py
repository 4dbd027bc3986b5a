"""Graph store, graph algorithms, batch control, data set tools and the trade workflow."""

from skein.operators.betweenness import betweenness, bfs_path_counts
from skein.operators.bfs import bfs_levels
from skein.operators.pagerank import pagerank
from skein.operators.registry import ALGORITHMS, run_algorithm
from skein.operators.store import GraphStore
from skein.operators.triangles import triangle_count

__all__ = ["ALGORITHMS", "GraphStore", "betweenness", "bfs_levels", "bfs_path_counts", "pagerank", "run_algorithm", "triangle_count"]
