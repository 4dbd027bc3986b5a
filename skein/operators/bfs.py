"""Breadth-first levels."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Scratch


def bfs_levels(edges: DataFrame, n: int, source: int, max_levels: int | None = None) -> DataFrame:
    """(vertex, level) of the vertices that `source` reaches over directed edges.

    Each round joins only the frontier with the edges; the visited set is read once for an anti
    join, and a round's rows are written so that the next plan starts from a scan. A source
    outside 0..n-1 reaches nothing (with a warning). Unreached vertices have no row.
    """
    spark = edges.sparkSession
    if not 0 <= source < n:
        warnings.warn(f"source {source} is outside 0..{n - 1}", stacklevel=2)
        return spark.createDataFrame([], "vertex long, level int")
    scratch = Scratch(spark)
    links = scratch.cut(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    visited = scratch.cut(spark.createDataFrame([(source, 0)], "vertex long, level int"))
    frontier, level = visited, 0
    while max_levels is None or level < max_levels:
        level += 1
        step = links.join(frontier.select(F.col("vertex").alias("src")), "src").select(F.col("dst").alias("vertex")).distinct()
        new = scratch.cut(step.join(visited, "vertex", "left_anti").select("vertex", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        old, visited = visited, scratch.cut(visited.unionByName(new))
        scratch.drop(old)
        frontier = new
    return visited


def with_unreached(levels: DataFrame, n: int) -> DataFrame:
    """All n vertices, level null where none was found."""
    return levels.sparkSession.range(n).select(F.col("id").alias("vertex")).join(levels, "vertex", "left")
