"""PageRank by pushes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Scratch

# Damping, iteration limit and the L1 change that ends the iteration.
DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 100, 1e-4


def pagerank(edges: DataFrame, n: int, iterations: int | None = None, damping: float = DAMPING, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(vertex, rank) over all n vertices; mass of vertices without out-edges is dropped.

    With `iterations` exactly so many rounds run, else until the L1 change is below
    `tolerance`. Parallel edges fold into a weight m/outdegree, so a round is one join on src and
    one aggregate on dst, and the change is read off the written round.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession)
    if n == 0:
        return spark.createDataFrame([], "vertex long, rank double")
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = scratch.cut(pairs.join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("w")))
    vertices = spark.range(n).select(F.col("id").alias("vertex"))
    ranks = scratch.cut(vertices.select("vertex", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations if iterations is not None else max_iterations):
        pushed = links.join(ranks.select(F.col("vertex").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = ranks.select("vertex", F.col("rank").alias("was")).join(pushed, "vertex", "left").select("vertex", "was", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        old, ranks = ranks, scratch.cut(new)
        scratch.drop(old)
        if iterations is None and ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
            break
    return ranks.select("vertex", "rank")
