"""Language identification (operator 6): multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.runtime import Scratch

#: About so many documents of each language are counted, by a hash of their id.
MAX_FIT = 4000
BITS = 16
ORDERS = (1, 2, 3)
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def grams(text: pa.Array):
    """Blocks of (first row, end row, bucket of each n-gram, n-gram's row start per order, letters per row).

    Texts are lower-cased; everything that is no letter counts as one and the same blank, and
    n-grams begin with a letter. A row's n-grams never reach into the next row.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.utf8_lower(text.fill_null("") if text.null_count else text)
    letter = _is_letter()
    for lo, hi, b, off in B.blocks(text):
        chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[off]
        cp = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        solid = letter[cp]
        cp = np.where(solid, cp, 32).astype(np.uint32)
        row = np.repeat(np.arange(hi - lo), np.diff(chars))
        parts = []
        h = np.zeros(len(cp), np.uint32)
        for n in ORDERS:
            m = len(cp) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(31) + cp[n - 1 :] * _MUL[n - 1]
            ok = solid[:m] & (row[:m] == row[n - 1 :])
            x = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E37)
            parts.append((row[:m][ok], (x >> np.uint32(32 - BITS)).astype(np.int32)))
        yield lo, hi, parts, np.bincount(row[solid], minlength=hi - lo)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of buckets x languages) of the rows of docs with a language.

    About max_fit documents of every language are counted, whole: those whose id hashes low
    enough. The matrix has 2^BITS rows whatever the input.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("g"), F.col(text_col).alias("t")).filter(F.col("g").isNotNull() & F.col("i").isNotNull())
    counts = own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("g").collect()  # one row per language
    langs = [r["g"] for r in counts]
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    limits = docs.sparkSession.createDataFrame([(r["g"], k, min(1.0, max_fit / r["n"])) for k, r in enumerate(counts)], "g string, k int, share double")
    u = F.pmod(F.xxhash64("i"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = own.join(limits, "g").filter(u < F.col("share")).select("k", "t")

    def count(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, parts, _ in grams(batch.column(1)):
                own = ks[lo:hi]
                for row, x in parts:
                    for k in np.unique(own):
                        acc.setdefault(int(k), np.zeros(1 << BITS, np.int64))
                        acc[int(k)] += np.bincount(x[own[row] == k], minlength=1 << BITS)
        for k, v in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], names=["k", "data"])

    def total(batches):
        now, acc = None, None
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([acc.tobytes()])], names=["k", "data"])
                    now, acc = k, np.zeros(1 << BITS, np.int64)
                acc += np.frombuffer(data, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([acc.tobytes()])], names=["k", "data"])

    schema = "k int, data binary"
    merged = scratch.cut(sample.mapInArrow(count, schema).repartition("k").sortWithinPartitions("k").mapInArrow(total, schema))
    counted = np.zeros((1 << BITS, len(langs)))
    for r in merged.collect():  # one row of a fixed size per language
        counted[:, r["k"]] = np.frombuffer(r["data"], np.int64)
    p = counted + smooth
    return langs, np.log(p / p.sum(axis=0)).astype(np.float32)


def predict_column(spark, langs: list[str], logp: np.ndarray):
    """A column function: text -> (lang_pred, score); `und` and 0 without letters or languages."""
    shared = spark.sparkContext.broadcast((langs, logp))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        langs, logp = shared.value
        names, scores = np.full(len(text), "und", object), np.zeros(len(text))
        if langs:
            by_lang = [np.ascontiguousarray(logp[:, k]) for k in range(len(langs))]
            for lo, hi, parts, letters in grams(pa.array(text, pa.string(), from_pandas=True)):
                total = np.zeros((hi - lo, len(langs)))
                for row, x in parts:
                    for k, column in enumerate(by_lang):
                        total[:, k] += np.bincount(row, weights=column[x], minlength=hi - lo)
                total -= total.max(axis=1, keepdims=True)
                p = np.exp(total)
                best = total.argmax(axis=1)
                has = letters > 0
                names[lo:hi][has] = np.array(langs, object)[best[has]]
                scores[lo:hi][has] = (p[np.arange(hi - lo), best] / p.sum(axis=1))[has]
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def identify(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "_lang", score_col: str = "_score") -> DataFrame:
    """docs with _lang, _score, from a model of the languages that `train` names.

    Texts that are null or hold no letter get `und` with score 0, and so do all if `train` names
    no language. Ids, languages and sources of docs are not looked at; rows that repeat are
    predicted each; an empty table gives none. The two columns can be named; columns of their
    names are replaced.
    """
    langs, logp = fit(train)
    p = B.free_name("_p", docs)
    out = docs.withColumn(p, predict_column(docs.sparkSession, langs, logp)(F.col(text_col)))
    return out.withColumn(lang_col, F.col(f"{p}.lang_pred")).withColumn(score_col, F.col(f"{p}.score")).drop(p)
