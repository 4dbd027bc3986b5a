"""Triangle count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Scratch

#: Vertices are dealt into this many groups, and an edge goes to as many cells, so what is shuffled
#: grows with the edges (9 groups make 165 cells, few enough for Spark to write without sorting);
#: more groups only where a cell would hold more than CELL edges otherwise.
GROUPS, CELL = 9, 3 << 20
#: Graphs of fewer edges are one cell.
SMALL = 1 << 14
#: Walks that a task looks at together.
_WALKS = 1 << 19


def _groups(edges: int) -> int:
    """A cell of three groups holds about 6 / groups^2 of the edges."""
    if edges < SMALL:
        return 1
    return max(GROUPS, int(np.ceil(np.sqrt(6 * edges / CELL))))


def count_cell(src: np.ndarray, dst: np.ndarray, m: np.ndarray, lone: np.ndarray) -> int:
    """Sum over triangles v0 < v1 < v2 of m(v0, v1) * m(v1, v2), but for those of three lone edges.

    Edges are distinct, with src < dst. They are turned from the end of smaller degree to the other,
    so a walk starts at most sqrt(2 * edges) ways from any edge.
    """
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(ids)
    order = np.lexsort((np.arange(n), np.bincount(ends, minlength=n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    s, d = place[ends[: len(src)]], place[ends[len(src) :]]
    a, b = np.minimum(s, d), np.maximum(s, d)
    keys = a * n + b
    by_key = np.argsort(keys)
    keys, a, b, m, lone = (x[by_key] for x in (keys, a, b, m, lone))
    after = np.searchsorted(a, a, "right") - np.arange(len(a)) - 1  # later edges of the same start
    done = np.concatenate([[0], np.cumsum(after)])
    total, lo = 0, 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + _WALKS, "right")) - 1)
        one = np.repeat(np.arange(lo, hi), after[lo:hi])
        two = one + 1 + np.arange(len(one)) - (done[one] - done[lo])
        want = b[one] * n + b[two]
        three = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        shut = keys[three] == want
        one, two, three = one[shut], two[shut], three[shut]
        # by id: the edge between the least and the largest end only has to exist
        x, y, z = order[a[one]], order[b[one]], order[b[two]]
        xy, xz = m[one], m[two]
        yz = m[three]
        walks = np.where((x < y) == (y < z), xy * yz, np.where((y < x) == (x < z), xy * xz, xz * yz))
        total += int(walks[~(lone[one] & lone[two] & lone[three])].sum())
        lo = hi
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task are one cell's."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([count_cell(*(np.concatenate(c) for c in zip(*parts, strict=True)))], pa.int64())], names=["n"])


def triangle_count(edges: DataFrame) -> DataFrame:
    """(triangles): ascending walks v0 < v1 < v2 that an edge v0->v2 closes.

    Parallel edges are folded into multiplicities first; walks multiply them and the closing edge
    only has to exist. Walks are never rows: vertices are dealt into groups, a cell is a choice of
    three groups (a group may be chosen again) and gets the edges between them, and a task counts
    the triangles of one cell whose ends lie in just these groups.
    """
    spark = edges.sparkSession
    up = edges.filter(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    up = Scratch(spark).cut(up.sortWithinPartitions("src", "dst"))  # neighbours share ends, which compress
    p = _groups(up.count())
    g, h, x = (F.col(c) for c in "ghx")
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    dealt = up.select("*", group("src").alias("g"), group("dst").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("x"))
    lo, hi = F.least(g, h, x), F.greatest(g, h, x)
    mid = g + h + x - lo - hi
    cell = F.expr("hi * (hi + 1) * (hi + 2) div 6 + mid * (mid + 1) div 2 + lo").cast("int")
    # a triangle within one group would show in every cell with that group: it counts in its own
    dealt = dealt.select("src", "dst", "m", ((g == h) & (x != g)).alias("lone"), lo.alias("lo"), mid.alias("mid"), hi.alias("hi"))
    dealt = dealt.select("src", "dst", "m", "lone", cell.alias("cell")).repartitionById(p * (p + 1) * (p + 2) // 6, "cell")
    counts = dealt.select("src", "dst", "m", "lone").mapInArrow(_count, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))
