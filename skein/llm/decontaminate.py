"""Benchmark decontamination (operator 9), in DataFrame functions alone.

Every item-sized window, at every position, that shares enough with an item to reach the
similarity is compared with it by the weighted cosine of the shingle sets. SimHash fingerprints
give the distance that is reported; no pair is left out for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.runtime import Scratch

#: Benchmark tables with more shingles than this are joined by shuffle instead of broadcast.
MAX_BROADCAST = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x0001000100010001


def words_of(text: Column) -> Column:
    """Words without ASCII white space, A-Z in lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPACE), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """xxhash64 of every k consecutive words.

    The words are bound to a lambda variable: written out, the optimizer would move the split of
    the whole text into the loop over positions.
    """
    empty = F.array().cast("array<long>")

    def every(w: Column) -> Column:
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(empty)

    return F.element_at(F.transform(F.array(words), every), 1)


def _lane_sums(h: Column, weight: Column) -> list[Column]:
    """16 sums that hold, in four lanes each, the weight with which every bit of h is set."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)) * weight).alias(f"s{j}") for j in range(16)]


def _fingerprint(total: Column) -> Column:
    """The bits whose lane holds at least half of the total weight."""
    out = F.lit(0).cast("long")
    for b in range(64):
        lane = F.shiftrightunsigned(F.col(f"s{b % 16}"), 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))
        bit = (1 << b) if b < 63 else -(1 << 63)
        out = out.bitwiseOR(F.when(lane * 2 >= total, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): windows that hold a benchmark item.

    A window has as many words as an item; the similarity of two shingle sets is the cosine of
    their weights, a shingle of many items weighing less. A pair of document and item has one row,
    that of its best window. Items of fewer than k words are one shingle of all their words;
    null and empty texts and items match nothing; a document shorter than an item is compared as
    a whole. Rows that repeat are reported once, ids may be null, an empty table gives none.

    All positions of a document are windows. What a window shares with an item changes only where
    a shared shingle enters or leaves, so a running sum over those places gives it for every
    position; below similarity^2 of the item's norm no window can reach the similarity, all others
    are cut from the text and compared. Nothing is broadcast but tables whose size has been counted.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bench = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0).withColumn("m", F.size("w")).withColumn("k", F.least("m", F.lit(k)))
    bench = scratch.cut(bench.distinct())
    kinds = sorted(r["k"] for r in bench.select("k").distinct().collect())  # k rows at most
    if not kinds:
        return spark.createDataFrame([], "doc_id long, item_id long, start long, n_words long, distance int, similarity double")
    sets = None
    for n in kinds:
        part = bench.filter(F.col("k") == n).select("item", "m", "k", F.posexplode(shingle_hashes(F.col("w"), n)).alias("at", "h"))
        sets = part if sets is None else sets.unionByName(part)
    sets = scratch.cut(sets)
    n_items = bench.count()
    df = sets.groupBy("h").agg(F.count_distinct("item", "m").alias("df"))
    weights = scratch.cut(df.select("h", F.greatest(F.lit(1), F.round(F.log((1.0 + n_items) / F.col("df")) * 32)).cast("long").alias("weight")))
    top = max(1, round(32 * math.log(1.0 + n_items)))
    n_sets = sets.count()
    small = n_sets <= MAX_BROADCAST
    hint = F.broadcast if small else (lambda x: x)

    square = F.col("weight") * F.col("weight")
    items_of = scratch.cut(sets.select("item", "m", "h").distinct().join(hint(weights), "h").withColumn("square", square))
    item_norm = scratch.cut(items_of.groupBy("item", "m").agg(F.sum("square").alias("item_norm")))
    least = max(0.0, similarity - 1e-9) ** 2  # the part of an item's norm that a window has to share

    # 1. places of the benchmark's shingles in documents
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64(F.col("doc").isNull(), "doc", "text"))
    found = None
    for n in kinds:
        own = keyed.select("key", shingle_hashes(words_of(F.col("text")), n).alias("hashes"))
        here = hint(sets.filter(F.col("k") == n).select("h").distinct())
        part = own.select("key", F.size("hashes").alias("size"), F.posexplode("hashes").alias("p", "h")).join(here, "h").select("key", F.lit(n).alias("k"), "size", "p", "h")
        found = part if found is None else found.unionByName(part)
    found = scratch.cut(found.distinct())

    # 2. pairs: with an item's shingles in order of weight, a document whose heaviest shared one
    # leaves too little of the norm from there on cannot reach the similarity
    own = W.partitionBy("item", "m")
    left = F.sum("square").over(own.orderBy("weight", "h").rowsBetween(W.unboundedPreceding, 0))
    heavy = items_of.select("item", "m", "h", left.alias("left"), F.sum("square").over(own).alias("all"))
    heavy = scratch.cut(heavy.filter(F.col("left") >= F.col("all") * least).select("item", "m", "h"))
    of_kind = F.least("m", F.lit(k)) == F.col("k")
    pairs = scratch.cut(found.select("key", "k", "h").distinct().join(hint(heavy), "h").filter(of_kind).select("key", "item", "m").distinct())

    # 3. what every window shares: a shingle counts in the windows that hold it and start after its last place before
    before = F.lag("p").over(W.partitionBy("key", "k", "h").orderBy("p"))
    shared = found.withColumn("before", before).join(hint(items_of), "h").filter(of_kind).join(pairs, ["key", "item", "m"])
    begin = F.greatest(F.lit(0), F.col("p") - F.col("m") + F.col("k"), F.coalesce("before", F.lit(-1)) + 1)
    last = F.greatest(F.lit(1), F.col("size") - F.col("m") + F.col("k"))
    events = F.array(F.struct(begin.alias("s"), F.col("square").alias("d")), F.struct((F.col("p") + 1).alias("s"), (-F.col("square")).alias("d")))
    events = shared.select("key", "item", "m", "k", last.alias("last"), F.explode(events).alias("e"))
    events = events.groupBy("key", "item", "m", "k", "last", F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d"))
    order = W.partitionBy("key", "item", "m", "k", "last").orderBy("s")
    spans = events.withColumn("both", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.withColumn("end", F.least(F.lead("s").over(order), F.col("last")) - 1).join(hint(item_norm), ["item", "m"])
    spans = spans.filter((F.col("both") > 0) & (F.col("both") >= F.col("item_norm") * least) & (F.col("end") >= F.col("s")))
    near = spans.select("key", "item", "m", "k", "both", "item_norm", F.explode(F.sequence("s", "end")).alias("start"))
    near = scratch.cut(near.withColumn("wid", F.xxhash64("key", "m", "start")))

    # 4. those windows, cut from the texts
    asked = scratch.cut(near.select("key", "k", "m", "start").distinct().groupBy("key", "k").agg(F.collect_list(F.struct("m", "start")).alias("asked")))
    few = F.broadcast if asked.count() <= MAX_BROADCAST else (lambda x: x)  # else all texts are shuffled
    texts = keyed.join(few(asked.select("key").distinct()), "key", "left_semi")
    cuts = None
    for n in kinds:
        part = texts.join(asked.filter(F.col("k") == n), "key")
        part = part.select("doc", "key", "k", "asked", shingle_hashes(words_of(F.col("text")), n).alias("hashes"))
        part = part.select("doc", "key", "k", "hashes", F.explode("asked").alias("a")).select("doc", "key", "k", "a.m", "a.start", "hashes")
        part = part.withColumn("win", F.array_distinct(F.slice("hashes", F.col("start") + 1, F.col("m") - F.col("k") + 1))).drop("hashes")
        cuts = part if cuts is None else cuts.unionByName(part)
    windows = cuts.groupBy("doc", "key", "m", "k", "start", "win").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    windows = scratch.cut(windows.withColumn("wid", F.xxhash64("key", "m", "start")))
    win_rows = windows.select("wid", F.explode("win").alias("h"), F.size("win").alias("n"))

    # 5. similarities, and the best windows of a document and item
    norms = win_rows.join(hint(weights), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(top)).cast("long")).groupBy("wid").agg(F.sum(square).alias("norm"))
    scored = near.join(norms, "wid").withColumn("similarity", F.col("both") / F.sqrt(F.col("norm").cast("double") * F.col("item_norm"))).filter(F.col("similarity") >= similarity - 1e-12)
    hits = scratch.cut(scored.select("wid", "item", "m", "similarity").join(windows.select("wid", "doc", "start"), "wid"))
    most = hits.groupBy(F.col("doc").alias("of_doc"), F.col("item").alias("of_item")).agg(F.max("similarity").alias("most"))
    hits = hits.join(most, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("item") == F.col("of_item")) & (F.col("similarity") == F.col("most")))
    hits = scratch.cut(hits.select("wid", "doc", "item", "m", "start", "similarity"))

    # fingerprints of windows and items: weighted bit sums over distinct shingles
    def prints(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.join(hint(weights), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(top)).cast("long"))
        # lanes are 16 bits wide: very long windows scale their weights down to fit
        cap = F.greatest(F.lit(1), F.expr(f"cast(floor(65535 / greatest(1, n * {top})) as long)"))
        scaled = F.when(F.col("n") * top <= 65535, F.col("weight")).otherwise(F.greatest(F.lit(1), F.least(cap, F.col("weight")))).cast("long")
        sums = rows.withColumn("lw", scaled).groupBy(*keys).agg(*_lane_sums(F.col("h"), F.col("lw")), F.sum("lw").alias("total"))
        return sums.select(*keys, _fingerprint(F.col("total")).alias("fp"))

    win_fp = prints(win_rows.join(hits.select("wid").distinct(), "wid"), ["wid"])
    item_rows = sets.groupBy("item", "m", "k").agg(F.collect_set("h").alias("set")).withColumn("n", F.size("set"))
    item_fp = scratch.cut(prints(item_rows.select("item", "m", "n", F.explode("set").alias("h")), ["item", "m"]).withColumnRenamed("fp", "item_fp"))
    hits = hits.join(win_fp, "wid").join(hint(item_fp), ["item", "m"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), F.col("m").alias("n_words"))).alias("b")
    out = hits.groupBy("doc", "item").agg(best)
    return scratch.cut(out.select(F.col("doc").alias("doc_id"), F.col("item").cast("long").alias("item_id"), (-F.col("b.s")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), (-F.col("b.d")).cast("int").alias("distance"), F.round("b.similarity", 6).alias("similarity")))
