"""Connected components of a link table, without ever gathering it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Scratch

_PAIR = "a long, b long"
#: Links that one task may reduce to a forest.
PER_TASK = 500_000


def forest(batches):
    """Per task: the spanning stars of what it reads (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((root(x) for x in list(parent)), np.int64, len(nodes))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 40, per_task: int = PER_TASK) -> DataFrame:
    """(node, root): for every linked node the smallest node of its component.

    Tasks first shrink their links, at most about per_task each, to forests; if one task was
    enough, its forest is the answer. Otherwise large-star and small-star steps alternate
    until the links stop changing; if max_rounds do not suffice, this raises. Least neighbours are partial aggregates written to a table,
    so the join back has plain scans on both sides and a hot node's rows can be split.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    tasks = -(-links.count() // per_task) or 1
    edges = scratch.cut(links.repartition(tasks).mapInArrow(forest, _PAIR))
    if tasks == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(max_rounds):
        both = scratch.cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(edges, both, least, large, low)
        edges = new
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
