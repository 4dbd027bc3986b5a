"""Column functions and ordering helpers."""

from skein.functions.draws import P, affine_permutation, draw, edge_key
from skein.functions.ordered import numbered, with_next

__all__ = ["P", "affine_permutation", "draw", "edge_key", "numbered", "with_next"]
