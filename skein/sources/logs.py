"""Benchmark logs and per-host traffic logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ["duration_ns", "max_rss", "cache_misses", "cache_references", "instructions", "minor_faults", "major_faults"]
# What the lines of a report begin with, and the stages' names in its headers.
LABELS = {"Duration": "duration_ns", "Max RSS": "max_rss", "Cache Misses": "cache_misses", "Cache References": "cache_references", "Instructions": "instructions", "Minor Page Faults": "minor_faults", "Major Page Faults": "major_faults"}
STAGES = {"Ingestion": "ingest", "Post-ingest": "post-ingest", "Algorithm": "algorithm"}


def _lines(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(file, seq, line) in the order of the files."""
    if not isinstance(source, DataFrame):
        return spark.read.text(source).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return source if "seq" in source.columns else source.withColumn("seq", F.monotonically_increasing_id())


def _found(pattern: str, group: int = 1) -> Column:
    """A group of a pattern in the line, null where it does not match."""
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def read_bench_logs(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """One row per file, batch and stage: dataset, algo, graph, threads, batch, stage and the metrics.

    A header `Benchmark results for <stage> for Batch <n>:` opens a section (words between the
    stage and the batch are passed over); `<label>: <number> [unit]` lines belong to the last
    header above them. Run settings come from `d=`, `a=`, `g=`, `t=` parts of the file name.
    `source` is a path or a DataFrame (file, line), with `seq` if its order is known.
    """
    rows = _lines(spark, source)
    header = r"Benchmark results for (\S+).* for Batch (\d+):"
    w = W.partitionBy("file").orderBy("seq")
    label, stage = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, name in LABELS.items():
        label = F.when(F.col("line").rlike(rf"^\s*{text}: *\d"), F.lit(name)).otherwise(label)
    for text, name in STAGES.items():
        stage = F.when(F.lower(_found(header)) == text.lower(), F.lit(name)).otherwise(stage)
    marked = rows.withColumns({"_b": _found(header, 2).cast("int"), "_s": F.coalesce(stage, F.lower(_found(header))), "metric": label, "value": _found(r": *(\d+)").try_cast("long")})
    marked = marked.withColumns({"batch": F.last("_b", True).over(w), "stage": F.last("_s", True).over(w)})
    named = marked.filter(F.col("metric").isNotNull() & F.col("batch").isNotNull())
    out = named.groupBy("file", "batch", "stage").pivot("metric", METRICS).agg(F.max("value"))
    key = lambda k: F.nullif(F.regexp_extract("file", rf"(?:^|[/_,]){k}=([^/_,.]+)", 1), F.lit(""))
    return out.select(key("d").alias("dataset"), key("a").alias("algo"), key("g").alias("graph"), key("t").try_cast("int").alias("threads"), "batch", "stage", *METRICS)


# What the counter lines of a host's log begin with.
COUNTERS = {"local_read": "local read (stream)", "master_reads": "master reads", "master_writes": "master writes", "mirror_reads": "mirror reads", "mirror_writes": "mirror writes"}


def read_traffic_logs(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(file, host, round, kind, peer, n): communication counters for each host and round.

    `#####   Round r` (any number of blanks) opens a round; counters above the first belong to
    none and are left out. A host's number is the last number in its file's name. Counter lines
    hold their number behind the last colon: `local read (stream): n`, `master reads: n`, `master writes: n`,
    `mirror reads: n`, `mirror writes: n`, and for each peer `remote communication for h: n`.
    """
    rows = _lines(spark, source)
    w = W.partitionBy("file").orderBy("seq")
    peer = _found(r"remote communication for (?:host )?(\d+)").try_cast("int")
    kind = F.when(peer.isNotNull(), F.lit("remote"))
    for name, text in COUNTERS.items():
        kind = kind.when(F.contains(F.col("line"), F.lit(text)), F.lit(name))
    n = _found(r".*:\s*(\d+)").try_cast("long")
    opens = F.col("line").rlike(r"#####\s+Round").cast("int")
    host = F.nullif(F.regexp_extract("file", r"(\d+)[^\d/]*$", 1), F.lit("")).try_cast("int")
    rows = rows.select("file", host.alias("host"), (F.sum(opens).over(w) - 1).cast("int").alias("round"), kind.alias("kind"), peer.alias("peer"), n.alias("n"))
    return rows.filter(F.col("kind").isNotNull() & F.col("n").isNotNull() & (F.col("round") >= 0))


def traffic_rounds(traffic: DataFrame) -> DataFrame:
    """Roll-up per round: stream reads, random reads, random writes, remote values."""
    total = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("n")).otherwise(0))
    return traffic.groupBy("round").agg(
        total("local_read").alias("stream_read"),
        total("master_reads", "mirror_reads").alias("random_read"),
        total("master_writes", "mirror_writes").alias("random_write"),
        total("remote").alias("remote"),
    )
