"""Edge sources: batched adjacency text, delimited edge lists, binary edge files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): the byte offset gives file order without reading a file in one task."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.Text",
    )
    return spark.createDataFrame(rdd, "pos long, line string")


def read_batched_text(spark: SparkSession, source: str | DataFrame, count_trailing_empty: bool = False) -> DataFrame:
    """Batched adjacency text -> (batch INT, src LONG, dst LONG).

    A line is `src d1 d2 ...`; a blank line ends a batch. `source` is a path or a DataFrame
    (pos, line). Parallel edges stay, empty tokens vanish, a line with only a source yields no
    edge. Batches without edges have no rows; `batch_count` counts them.
    """
    lines = source if isinstance(source, DataFrame) else _lines(spark, source)
    ends = np.array(sorted(r[0] for r in lines.filter(F.trim("line") == "").select("pos").collect()), dtype="int64")  # one per batch

    @F.pandas_udf("int")
    def batch_of(pos: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, pos.to_numpy(), side="left").astype("int32"))

    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")
    rows = lines.filter(F.trim("line") != "").select(batch_of("pos").alias("batch"), tokens.alias("t"))
    return rows.select("batch", F.col("t")[0].cast("long").alias("src"), F.explode(F.slice("t", 2, 1 << 30)).alias("dst")).select(
        "batch", "src", F.col("dst").cast("long").alias("dst")
    )


def batch_count(spark: SparkSession, source: str | DataFrame, count_trailing_empty: bool = False) -> int:
    """How many times the algorithm runs: batches, empty ones between blank lines included."""
    lines = source if isinstance(source, DataFrame) else _lines(spark, source)
    blank = F.trim("line") == ""
    row = lines.agg(F.sum(F.when(blank, 1).otherwise(0)).alias("ends"), F.max(F.when(~blank, F.col("pos"))).alias("last")).first()
    if row["last"] is None:
        return row["ends"] or 0 if count_trailing_empty else 0
    before = lines.filter(blank & (F.col("pos") < row["last"])).count()
    return (row["ends"] + 1) if count_trailing_empty else before + 1


def read_edge_list(spark: SparkSession, path: str | list[str], sep: str = " ", comment: str = "#") -> DataFrame:
    """Delimited `src dst` lines (exactly two fields); other lines are dropped."""
    df = spark.read.csv(path, sep=sep, comment=comment, schema="src long, dst long, _bad string", columnNameOfCorruptRecord="_bad", mode="PERMISSIVE")
    whole = F.col("_bad").isNull()  # holds the line if a field does not parse, or there are more or fewer
    return df.filter(whole & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")


def read_bel(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Binary edges, 16 bytes each (little-endian uint64 pair) -> (edge_idx, src, dst).

    The scan is the binaryFile source cut into fixed records by splits of the Hadoop reader;
    a size that 16 does not divide is an error.
    """
    sc = spark.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = fs_path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    if size % 16:
        raise ValueError(f"{path}: {size} bytes is not a whole number of 16-byte edges")

    def rows(records):
        buf = b"".join(records)
        pairs = np.frombuffer(buf, dtype="<u8").astype("int64").reshape(-1, 2)
        return ((int(a), int(b)) for a, b in pairs)

    def blocks(part):
        chunk = []
        for rec in part:
            chunk.append(bytes(rec))
            if len(chunk) == 65536:
                yield from rows(chunk)
                chunk = []
        yield from rows(chunk)

    rdd = sc.binaryRecords(path, 16).mapPartitions(blocks).zipWithIndex().map(lambda x: (x[1], *x[0]))
    df = spark.createDataFrame(rdd, "edge_idx long, src long, dst long")
    if start or end is not None:
        df = df.filter((F.col("edge_idx") >= start) & (F.col("edge_idx") < (end if end is not None else size // 16)))
    return df


def to_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts sorted): the ingest form; parallel edges stay."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def from_adjacency(adj: DataFrame) -> DataFrame:
    return adj.select("src", F.explode("dsts").alias("dst"))
