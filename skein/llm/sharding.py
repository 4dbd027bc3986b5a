"""Sharding by sampled splitters (operator 10): shards of nearly equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm.setjoin import NO_ID
from skein.runtime import Scratch

#: Key samples a round draws, and the most rounds of subdividing.
SAMPLES, ROUNDS = 8192, 4


def weighted_splitters(keys: DataFrame, ranges: int, samples: int, total: int) -> np.ndarray:
    """Range boundaries: quantiles of a size-weighted sample of (k1, k2, rid) without replacement.

    Every row races with -ln(u) / size, u a hash of its own; the first `samples` are the sample.
    By the total size, at most about 4 * samples rows finish in the time that is looked at
    first, so what is sent to the driver does not grow with the table.
    """
    u = (F.pmod(F.xxhash64("k1", "k2", "rid"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 1)
    race = keys.select("k1", "k2", "rid", (-F.log(u) / F.col("size")).alias("_race"))
    early = race.filter(F.col("_race") < 4.0 * samples / max(1, total))
    won = early.orderBy("_race").limit(samples).select("k1", "k2", "rid").collect()  # `samples` rows
    if len(won) < samples // 4:  # a few records hold nearly all bytes, or there are few
        won = race.orderBy("_race").limit(samples).select("k1", "k2", "rid").collect()
    if not won:
        return np.zeros((0, 3), np.int64)
    rows = np.array(sorted((r["k1"], r["k2"], r["rid"]) for r in won), np.int64)
    at = np.unique(np.linspace(0, len(rows), ranges + 1).astype(int)[1:-1])
    return np.unique(rows[at[at < len(rows)]], axis=0)


def _range_of(spark, splitters: np.ndarray):
    packed = np.zeros(len(splitters), [("a", "i8"), ("b", "i8"), ("c", "i8")])
    packed["a"], packed["b"], packed["c"] = splitters.T if len(splitters) else ([], [], [])
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("int")
    def of(k1: pd.Series, k2: pd.Series, rid: pd.Series) -> pd.Series:
        split = shared.value
        lo = np.searchsorted(split["a"], k1.to_numpy(), "left")
        hi = np.searchsorted(split["a"], k1.to_numpy(), "right")
        out = hi.copy()
        cut = np.flatnonzero(hi > lo)  # equal first keys: copies of one text that a splitter cuts
        if len(cut):
            own = np.empty(len(cut), split.dtype)
            own["a"], own["b"], own["c"] = (x.to_numpy()[cut] for x in (k1, k2, rid))
            out[cut] = np.searchsorted(split, own, "right")
        return pd.Series(out.astype("int32"))

    return of


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, text_hash): shards 0.. of nearly equal total size.

    Size is the text's UTF-8 bytes (null: none) plus one. Records are ordered by the hash of
    their text, then id, so equal texts are neighbours and share a shard unless a boundary falls
    among them. Size-weighted samples give splitters of many small ranges; ranges that turn out
    overfull are subdivided by samples of their own. Within a range, running sums over the sorted
    records place every record at its exact byte, so shards differ by about one record's size.
    Null ids sort first, rows that repeat are placed each, other columns are ignored, an empty
    table gives none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
    )
    base = scratch.cut(base.withColumn("rid", F.monotonically_increasing_id()).withColumn("k2", F.coalesce("doc_id", F.lit(NO_ID).cast("long"))))
    ranges = max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    split = weighted_splitters(base, ranges, samples, total)
    for _ in range(ROUNDS):
        placed = base.withColumn("range", _range_of(spark, split)("k1", "k2", "rid"))
        sums = {r["range"]: (r["s"], r["n"], r["m"]) for r in placed.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).collect()}  # one row a range
        limit = 2 * total / max(1, ranges)
        over = [k for k, (s, n, m) in sums.items() if n > 1 and s > limit and s > 2 * m]
        if not over:
            break
        part = placed.filter(F.col("range").isin(over))
        parts = int(sum(sums[k][0] for k in over) / limit * 4) + 2
        split = np.unique(np.concatenate([split, weighted_splitters(part, parts, samples, sum(sums[k][0] for k in over))]), axis=0)
    at, before = 0, {}
    for k in sorted(sums):
        before[k] = at
        at += sums[k][0]
    shared = spark.sparkContext.broadcast((before, at))

    def place(batches):
        now, run = None, 0
        starts, whole = shared.value
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            size = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = k[0] != now
            sums = np.cumsum(size)
            first = np.flatnonzero(new)
            base = np.full(len(k), run, np.int64)
            for i, j in zip(first, np.append(first, len(k))[1:], strict=True):  # rows before the first go on from the last batch
                base[i:j] = starts[int(k[i])] - (sums[i - 1] if i else 0)
            end = base + sums
            now, run = k[-1], end[-1]
            mid = end - (size + 1) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mid * shards // whole, shards - 1).astype(np.int32)), *batch.columns], names=["shard", *batch.schema.names])

    cols = "range int, size long, k1 long, k2 long, rid long, doc_id long, text_crc32 long"
    names = [c.split()[0] for c in cols.split(", ")]
    spread = placed.select(*names).repartition(ranges, "range").sortWithinPartitions("range", "k1", "k2", "rid")
    out = scratch.cut(spread.mapInArrow(place, "shard int, " + cols))
    # slots: ranks in key order within a shard, from local ranks and the counts of earlier ranges
    from pyspark.sql import Window as W

    counts = out.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("shard", "range", (F.sum("n").over(W.partitionBy("shard").orderBy("range")) - F.col("n")).alias("ahead"))  # a row for each range
    rank = F.row_number().over(W.partitionBy("range", "shard").orderBy("k1", "k2", "rid"))
    slots = out.withColumn("_r", rank).join(ahead, ["shard", "range"]).withColumn("slot", F.col("ahead") + F.col("_r") - 1)
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), F.col("k1").alias("text_hash"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as one folder of Parquet files per shard, with `shard` and `slot`.

    Every row of docs is written once: rows meet their places by id, null included, and text;
    rows that repeat both take the places of their kind in turn. The columns must not be called
    shard or slot.
    """
    from pyspark.sql import Window as W

    own, key = [B.free_name(c, docs) for c in ("_id", "_hash", "_nth")], ["_i", "_h", "_o"]
    rows = docs.withColumns({own[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")), own[1]: F.xxhash64(text_col)})
    rows = rows.withColumn(own[2], F.row_number().over(W.partitionBy(*own[:2]).orderBy(F.lit(0))))
    place = assigned.select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("_i"), F.col("text_hash").alias("_h"), "shard", "slot")
    place = place.withColumn("_o", F.row_number().over(W.partitionBy("_i", "_h").orderBy("shard", "slot")))
    on = [rows[a] == place[b] for a, b in zip(own, key, strict=True)]
    out = rows.join(place, on).select(*[rows[c] for c in docs.columns], place["shard"], place["slot"])
    out.write.mode("overwrite").partitionBy("shard").parquet(path)
