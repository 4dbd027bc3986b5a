"""Global order without a one-task window: range partitions, local ranks, offsets per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.runtime import Scratch


def numbered(df: DataFrame, order: list[str], name: str = "rn", start: int = 0, partitions: int | None = None) -> DataFrame:
    """Add a gapless BIGINT position in the order of `order`.

    Rows are range-partitioned once and written; each partition numbers its own rows, and
    the offsets are a running sum over one row per partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = Scratch(spark).cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_off"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        placed.withColumn("_rank", rank.cast("long"))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_rank") - 1 + start)
        .drop("_part", "_off", "_rank")
    )


def with_next(df: DataFrame, order: list[str], col: str, name: str) -> DataFrame:
    """Add `col` of the following row in the global order (null on the last row)."""
    rows = numbered(df, order, "_rn")
    ahead = rows.select((F.col("_rn") - 1).alias("_rn"), F.col(col).alias(name))
    return rows.join(ahead, "_rn", "left").drop("_rn")
