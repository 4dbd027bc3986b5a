"""Batch control: split an ordered edge table, run ingest / post-ingest / algorithm per batch, measure."""

from __future__ import annotations

import itertools
import math
import resource
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.registry import run_algorithm
from skein.operators.store import GraphStore


def assign_batches(edges: DataFrame, total: int, batches: int, startup: float = 0.0, idx: str = "edge_idx") -> DataFrame:
    """Add `batch`: -1 for the first floor(total*startup) edges, then equal batches of ceil(rest/batches)."""
    if not 0 <= startup <= 1 or batches < 1:
        raise ValueError("startup must be in 0..1 and batches at least 1")
    pre = math.floor(total * startup)
    size = max(1, math.ceil((total - pre) / batches))
    return edges.withColumn("batch", F.when(F.col(idx) < pre, F.lit(-1)).otherwise(F.expr(f"({idx} - {pre}) div {size}")).cast("int"))


def batch_report(edges: DataFrame) -> DataFrame:
    """(batch, modified_vertices, edges)."""
    return edges.groupBy("batch").agg(F.countDistinct("src").alias("modified_vertices"), F.count(F.lit(1)).alias("edges"))


def in_range(edges: DataFrame, n: int) -> DataFrame:
    """Edges whose two ends are below n."""
    return edges.filter(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))


def _measure(stage: str, batch: int, work: Callable[[], object]) -> tuple[object, dict]:
    before, began = resource.getrusage(resource.RUSAGE_SELF), time.perf_counter_ns()
    out = work()
    after = resource.getrusage(resource.RUSAGE_SELF)
    return out, {
        "batch": batch, "stage": stage, "duration_ns": time.perf_counter_ns() - began, "max_rss": after.ru_maxrss,
        "minor_faults": after.ru_minflt - before.ru_minflt, "major_faults": after.ru_majflt - before.ru_majflt,
        "cache_misses": None, "cache_references": None, "instructions": None,
    }


METRIC_SCHEMA = "batch int, stage string, duration_ns long, max_rss long, minor_faults long, major_faults long, cache_misses long, cache_references long, instructions long"


def run_batches(store: GraphStore, batches: Iterable[DataFrame | None], algo: str = "nop", startup: DataFrame | None = None, ingest_partitions: int = 0, algo_partitions: int = 0, **options) -> Iterator[tuple[int, DataFrame, list[dict]]]:
    """Yield (batch, result, metrics); None is an empty batch: no ingest, but the algorithm runs."""
    conf = store.spark.conf
    usual = conf.get("spark.sql.shuffle.partitions")

    def within(n: int, work):
        conf.set("spark.sql.shuffle.partitions", str(n) if n else usual)
        try:
            return work()
        finally:
            conf.set("spark.sql.shuffle.partitions", usual)

    if startup is not None:
        store.commit(startup)
    for i, rows in enumerate(batches):
        metrics = []
        if rows is not None:
            _, m = _measure("ingest", i, lambda rows=rows: within(ingest_partitions, lambda: store.ingest(rows)))
            metrics.append(m)
            _, m = _measure("post-ingest", i, store.post_ingest)
            metrics.append(m)
        out, m = _measure("algorithm", i, lambda: within(algo_partitions, lambda: run_algorithm(algo, store, **options)))
        yield i, out, [*metrics, m]


def metrics_table(spark, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], METRIC_SCHEMA)


def parameter_grid(**axes: Iterable) -> list[dict]:
    """Every combination of the given settings, for launchers."""
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]
