"""Algorithms by name; each takes a GraphStore and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skein.operators.betweenness import betweenness, sample_sources
from skein.operators.bfs import bfs_levels
from skein.operators.pagerank import pagerank
from skein.operators.store import GraphStore
from skein.operators.triangles import triangle_count


def nop(store: GraphStore) -> DataFrame:
    """Ingest only: one row with the sizes that are known without a job."""
    return store.spark.createDataFrame([(store.size(), store.edge_count())], "vertices long, edges long")


def _bc(store: GraphStore, num_src: int | None = None, seed: int = 0) -> DataFrame:
    chosen = None if num_src is None else sample_sources(store.size(), num_src, seed, store.spark)
    return betweenness(store.edges(), store.size(), chosen)


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "nop": nop,
    "bfs": lambda store, source: bfs_levels(store.edges(), store.size(), source),
    "tc": lambda store: triangle_count(store.edges()),
    "pr": lambda store, **k: pagerank(store.edges(), store.size(), **k),
    "bc": _bc,
}


def register(name: str, run: Callable[..., DataFrame]) -> None:
    """Add a user-defined algorithm."""
    ALGORITHMS[name] = run


def run_algorithm(name: str, store: GraphStore, **options) -> DataFrame:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {name}")
    if name == "bfs" and "source" not in options:
        raise ValueError("bfs needs a source")
    return ALGORITHMS[name](store, **options)


__all__ = ["ALGORITHMS", "nop", "register", "run_algorithm"]
