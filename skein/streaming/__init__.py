"""A stream of edge batches into a graph store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.operators.registry import run_algorithm
from skein.operators.store import GraphStore


def read_edge_stream(spark: SparkSession, folder: str, schema: str = "src long, dst long", files_per_batch: int = 1) -> DataFrame:
    """A streaming read of Parquet edge files, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def replay(stream: DataFrame, store: GraphStore, on_result: Callable[[int, DataFrame], None], checkpoint: str, algo: str = "nop", **options):
    """Start a query that commits every micro-batch and then runs the algorithm on the graph so far.

    A micro-batch that Spark hands over again after a restart of the query is not added twice:
    the store keeps the ids that it has seen.
    """
    seen: set[int] = set()

    def step(batch: DataFrame, epoch: int) -> None:
        if epoch not in seen:
            seen.add(epoch)
            store.commit(batch.select("src", "dst"))
        on_result(epoch, run_algorithm(algo, store, **options))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
