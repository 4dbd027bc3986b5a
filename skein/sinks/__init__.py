"""Writers: algorithm sections, batched text, binary edges, compressed rows, CSV, traffic stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ordered import numbered

# The column headers of the five data set files.
HEADERS = {
    "commercial": ("type,person1,person2,topic,date,lat,lon,amount", "STRING,UINT,UINT,UINT,DATE,DOUBLE,DOUBLE,DOUBLE"),
    "cyber": ("src,dst,epoch_time,duration,protocol,src_port,dst_port,src_packets,dst_packets,src_bytes,dst_bytes", ",".join(["UINT"] * 11)),
    "social": ("person1,person2", "UINT,UINT"),
    "uses": ("person,device", "UINT,UINT"),
    "nodes": ("type,id,unused1,unused2,unused3,unused4,unused5", "STRING,UINT,STRING,STRING,STRING,STRING,STRING"),
}


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result table; with a `batch` column, one folder per batch."""
    w = df.write.mode(mode)
    (w.partitionBy("batch") if "batch" in df.columns else w).parquet(path)


def result_text(algo: str, batch: int, value: int | None = None) -> str:
    """The section that a text report holds for one batch."""
    body = f"Number of triangles: {value}" if algo == "tc" else "done"
    return f"==== running {algo} after batch {batch} ====\n{body}\n"


def batched_lines(edges: DataFrame) -> DataFrame:
    """(batch, src, line): edges of a batch grouped by source and sorted."""
    adj = edges.groupBy("batch", "src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    return adj.select("batch", "src", F.concat_ws(" ", F.col("src").cast("string"), F.transform("d", lambda x: x.cast("string"))).alias("line"))


def write_batched_text(edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """Batched adjacency text in range-ordered parts; a blank line closes each batch."""
    lines = batched_lines(edges).select("batch", F.lit(0).alias("_k"), "src", "line")
    ends = edges.select("batch").distinct().select("batch", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("src"), F.lit("").alias("line"))
    n = partitions or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = lines.unionByName(ends).repartitionByRange(n, "batch", "_k", "src").sortWithinPartitions("batch", "_k", "src")
    out.select("line").write.mode("overwrite").text(path)


def _seven_bytes(c: str):
    """The low seven bytes of a BIGINT, little-endian, as text with raw bytes; 2^56 and above fail."""
    checked = F.when(F.col(c).between(0, (1 << 56) - 1), F.col(c)).otherwise(F.raise_error(F.lit("a value of 2^56 or more can't be written")).cast("long"))
    hexed = F.lpad(F.hex(checked), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(7)]))


def write_u64(df: DataFrame, path: str, order: str, values: list[str]) -> None:
    """Raw little-endian uint64 values; the parts, in name order, are the file.

    The text writer emits seven bytes of the last value and its line separator, a zero byte,
    is the eighth: a distributed raw binary writer without any Python.
    """
    zero = F.unhex(F.lit("00"))
    pieces = []
    for i, c in enumerate(values):
        pieces += [_seven_bytes(c)] + ([zero] if i < len(values) - 1 else [])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, order).sortWithinPartitions(order)
    rows.select(F.concat(*pieces).cast("string").alias("line")).write.mode("overwrite").option("lineSep", "\0").text(path)


def write_bel(edges: DataFrame, path: str) -> None:
    """Binary edge records in the order of `edge_idx` (numbered by src, dst if it is absent)."""
    rows = edges if "edge_idx" in edges.columns else numbered(edges, ["src", "dst"], "edge_idx")
    write_u64(rows, path, "edge_idx", ["src", "dst"])


def _u64(df: DataFrame, head: list[int], pos: str, value: str) -> DataFrame:
    """(pos, value) with header values in front."""
    top = df.sparkSession.createDataFrame([(i - len(head), v) for i, v in enumerate(head)], "pos long, value long")
    return top.unionByName(df.select(F.col(pos).cast("long").alias("pos"), F.col(value).cast("long").alias("value")))


def write_csr_offsets(edges: DataFrame, n: int, path: str) -> None:
    """Column file of row ends: count, 0, then one inclusive offset for each vertex."""
    write_u64(_u64(csr_offsets(edges, n), [n, 0], "vertex", "row_end"), path, "pos", ["value"])


def write_csr_destinations(edges: DataFrame, path: str) -> None:
    """Column file of destinations in row order: count, 0, then the values."""
    write_u64(_u64(csr_destinations(edges), [edges.count(), 0], "idx", "dst"), path, "pos", ["value"])


def write_gr(edges: DataFrame, n: int, path: str) -> None:
    """Binary graph, version 2, without edge data: header, row ends, destinations."""
    m = edges.count()
    ends = _u64(csr_offsets(edges, n), [2, 0, n, m], "vertex", "row_end")
    dsts = csr_destinations(edges).select((F.col("idx") + n).alias("pos"), F.col("dst").alias("value"))
    write_u64(ends.unionByName(dsts), path, "pos", ["value"])


def csr_offsets(edges: DataFrame, n: int) -> DataFrame:
    """(vertex, degree, row_end): inclusive running degree over all n vertices, empty ones too."""
    degree = edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
    rows = edges.sparkSession.range(n).select(F.col("id").alias("vertex")).join(degree, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running_sum(rows, "vertex", "degree", "row_end")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """An inclusive prefix sum in two levels: within range partitions, then over their totals."""
    from pyspark.sql import Window as W

    from skein.runtime import Scratch

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = Scratch(spark).cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.select("_part", (F.sum("_t").over(W.orderBy("_part")) - F.col("_t")).alias("_before"))
    local = F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_s", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_s") + F.col("_before")).drop("_s", "_before", "_part")


def csr_destinations(edges: DataFrame) -> DataFrame:
    """(idx, dst): destinations in row order."""
    return numbered(edges.select("src", "dst"), ["src", "dst"], "idx").select("idx", "dst")


def write_dataset_csv(df: DataFrame, path: str, kind: str) -> None:
    """A CSV file set whose parts open with the `#delimiter`, `#columns`, `#types` lines."""
    columns, types = HEADERS[kind]
    body = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"), F.lit(1).alias("_k"))
    head = df.sparkSession.createDataFrame([(f"#delimiter: ,\n#columns:{columns}\n#types:{types}", 0)], "line string, _k int")
    head.unionByName(body).select("line").write.mode("overwrite").text(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def traffic_stats(traffic: DataFrame) -> DataFrame:
    """(step, line): the step report of `read_traffic_logs` rows; 8 bytes a value.

    Even steps compute: a `# h h` section for each host with stream reads, random reads and
    random writes, as count and bytes. Odd steps communicate: a `# h p` section for each host
    and peer. Zero counts have no line, sections without lines are left out.
    """
    total = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("n")).otherwise(0))
    entry = lambda name, n: F.when(n > 0, F.concat(F.lit(f"\n{name} "), n, F.lit(" "), n * 8)).otherwise(F.lit(""))
    own = traffic.groupBy("round", "host").agg(total("local_read").alias("s"), total("master_reads", "mirror_reads").alias("r"), total("master_writes", "mirror_writes").alias("w"))
    own = own.select((F.col("round") * 2).alias("step"), "host", F.col("host").alias("peer"), F.concat(entry("STR RD", F.col("s")), entry("RND RD", F.col("r")), entry("RND WR", F.col("w"))).alias("t"))
    sent = traffic.filter((F.col("kind") == "remote") & (F.col("peer") != F.col("host"))).groupBy("round", "host", "peer").agg(F.sum("n").alias("n"))
    sent = sent.select((F.col("round") * 2 + 1).alias("step"), "host", "peer", entry("RND RMW", F.col("n")).alias("t"))
    part = F.struct("host", "peer", F.concat(F.lit("\n# "), "host", F.lit(" "), "peer", "t").alias("t"))
    parts = own.unionByName(sent).filter("t <> ''").groupBy("step").agg(F.sort_array(F.collect_list(part)).alias("p"))  # a part for each pair of hosts at most
    steps = traffic.select("round").distinct().select(F.explode(F.array(F.col("round") * 2, F.col("round") * 2 + 1)).alias("step"))
    body = F.array_join(F.transform(F.coalesce("p", F.array().cast("array<struct<host:int,peer:int,t:string>>")), lambda x: x["t"]), "")
    return steps.join(parts, "step", "left").select("step", F.concat(F.lit("BSP "), "step", body).alias("line"))
