"""Betweenness: all sources advance together, keyed by (source, vertex)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.draws import draw
from skein.runtime import Scratch


def sample_sources(n: int, k: int, seed: int, spark) -> DataFrame:
    """(source): k vertices in hash order, all n if k is larger."""
    return spark.range(n).select(F.col("id").alias("source")).orderBy(draw(seed, F.lit(0).cast("long"), F.col("source")), "source").limit(min(k, n))


def bfs_path_counts(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, int]:
    """((source, vertex, level, sigma), depth): shortest-path counts; parallel edges multiply."""
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession)
    links = scratch.cut(edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m")))
    seen = scratch.cut(sources.select("source", F.col("source").alias("vertex"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
    frontier, depth = seen, 0
    while True:
        step = frontier.select("source", F.col("vertex").alias("src"), "sigma").join(links, "src").groupBy("source", F.col("dst").alias("vertex")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        new = scratch.cut(step.join(seen, ["source", "vertex"], "left_anti").select("source", "vertex", F.lit(depth + 1).alias("level"), "sigma"))
        if new.isEmpty():
            return seen, depth
        depth += 1
        old, seen = seen, scratch.cut(seen.unionByName(new))
        scratch.drop(old)
        frontier = new


def betweenness(edges: DataFrame, n: int, sources: DataFrame | None = None, block: int = 64) -> DataFrame:
    """(vertex, score): directed, unweighted, unnormalised and not halved; sources score nothing for themselves.

    About `block` sources advance together, which bounds the state to block * n rows; the blocks'
    scores are summed.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession)
    sources = sources if sources is not None else spark.range(n).select(F.col("id").alias("source"))
    sources = scratch.cut(sources)
    blocks, total = -(-sources.count() // block), None
    for b in range(blocks):
        part = scratch.cut(_scores(edges, n, sources.filter(F.pmod(F.xxhash64("source"), F.lit(blocks)) == b)))
        total = part if total is None else total.unionByName(part)
    scores = total.groupBy("vertex").agg(F.sum("score").alias("score")) if total is not None else spark.createDataFrame([], "vertex long, score double")
    return spark.range(n).select(F.col("id").alias("vertex")).join(scores, "vertex", "left").select("vertex", F.coalesce("score", F.lit(0.0)).alias("score"))


def _scores(edges: DataFrame, n: int, sources: DataFrame) -> DataFrame:
    """(vertex, score) of the vertices that the sources reach."""
    scratch = Scratch(edges.sparkSession)
    seen, depth = bfs_path_counts(edges, sources.filter(F.col("source").between(0, n - 1)))
    links = scratch.cut(edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m")))
    done = scratch.cut(seen.filter(F.col("level") == depth).select("source", "vertex", "level", "sigma", F.lit(0.0).alias("delta")))
    below = done
    for level in range(depth - 1, 0, -1):
        here = seen.filter(F.col("level") == level)
        share = below.select("source", F.col("vertex").alias("dst"), ((F.lit(1.0) + F.col("delta")) / F.col("sigma")).alias("share"))
        gained = links.join(share, "dst").groupBy("source", F.col("src").alias("vertex")).agg(F.sum(F.col("m") * F.col("share")).alias("g"))
        here = here.join(gained, ["source", "vertex"], "left").select("source", "vertex", "level", "sigma", (F.col("sigma") * F.coalesce("g", F.lit(0.0))).alias("delta"))
        below = scratch.cut(here)
        done = scratch.cut(done.unionByName(below))
    return done.filter(F.col("level") > 0).groupBy("vertex").agg(F.sum("delta").alias("score"))
