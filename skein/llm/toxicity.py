"""Toxicity scores (operator 2): FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.runtime import Scratch

#: The learner takes at most so many documents of either label, in the order of a hash of their id.
MAX_FIT = 10_000
#: and fewer of them if their texts hold more bytes than this.
MAX_BYTES = 256 << 20
BITS = 22
#: Bytes of a word's stem: inflected forms share it.
STEM = 4


@dataclass(frozen=True)
class Model:
    """What scoring needs: the features with a weight, ascending, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _letters(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(text.fill_null("") if text.null_count else text)


_WORD = np.zeros(256, np.uint8) + 32
_WORD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_WORD[128:] = np.arange(128, 256)
_STEM_SALT = np.uint64(0x94D049BB133111EB)
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(batch_text: pa.Array):
    """Blocks of (first row, end row, row of each feature, feature).

    Features are words, the stems of longer words, neighbours, and pairs one word apart.
    """
    text = _letters(batch_text.combine_chunks() if isinstance(batch_text, pa.ChunkedArray) else batch_text)
    for lo, hi, b, off in B.blocks(text):
        b = _WORD[b]  # all but letters is space
        s, e, first = B.word_spans(b, off)
        w = B.word_hashes(b, s, e)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        long = e - s > STEM
        stems = B.word_hashes(b, s[long], s[long] + STEM)
        rows, found = [row, row[long]], [w, B.mix(stems + _STEM_SALT)]
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            if len(w) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                found.append(B.mix((w[:-gap] * salt + w[gap:] + np.uint64(gap))[same]))
        yield lo, hi, np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 6, seed: int = 1) -> Model:
    """FTRL-proximal with a rate for each coordinate; L1 leaves most weights at exactly zero.

    State is held for features that occur, not for all 2^BITS.
    """
    occurs = np.zeros(1 << BITS, bool)
    for x in docs:
        occurs[x] = True
    known = np.flatnonzero(occurs)
    place = np.zeros(1 << BITS, np.int32)
    place[known] = np.arange(len(known))
    z, n, zb, nb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    rng = np.random.default_rng(seed)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            x = place[docs[i]]
            w = weights(z[x], n[x], l1)
            wb = float(weights(zb, nb, 0.0))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = (p - labels[i]) * weight[i]
            if abs(g) < 1e-6:
                continue
            root = np.sqrt(n[x] + g * g)
            z[x] += g - (root - np.sqrt(n[x])) / alpha * w
            n[x] += g * g
            rb = np.sqrt(nb + g * g)
            zb, nb = zb + g - (rb - np.sqrt(nb)) / alpha * wb, nb + g * g
    found = np.flatnonzero(np.abs(z) > l1)
    return Model(known[found], weights(z[found], n[found], l1), float(weights(zb, nb, 0.0)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT, max_bytes: int = MAX_BYTES) -> Model:
    """A model of the labelled rows of `labels` whose text `docs` has, at most max_fit of each label.

    The sample is the first rows by a hash of the id, whole texts, in the proportion of max_bytes
    fewer if theirs hold more; it is balanced back by weights to the labels' own proportions. One
    task learns from it: its size is the bounds'. Of an id's labels the largest counts, rows that
    repeat an id are learned from each.
    """
    scratch = Scratch(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows

    def sampled(limit: int) -> DataFrame:
        part = [B.first_by_hash(own.filter(F.col("y") == y), ["i"], counts.get(y, 0), limit) for y in (0, 1)]
        picked = scratch.cut(part[0].unionByName(part[1]))
        return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), "i").select("i", "t", "y")  # broadcast: 2 * max_fit rows

    sample = sampled(max_fit)
    size = sample.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > max_bytes:
        max_fit = max(1, int(min(max_fit, max(counts.values())) * max_bytes / size))
        sample = sampled(max_fit)
    share = {y: counts.get(y, 0) / max(1, min(counts.get(y, 0), max_fit)) for y in (0, 1)}
    scale = max(1.0, min(share.values()))

    def learn(batches):
        found, ys, keys = [], [], []
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            keys += batch.column(0).to_pylist()
            for lo, hi, row, f in features(batch.column(1)):
                start = np.searchsorted(np.sort(row), np.arange(hi - lo + 1))
                f = f[np.argsort(row, kind="stable")]
                found += [np.unique(f[start[i] : start[i + 1]]).astype(np.int32) for i in range(hi - lo)]
                ys.append(y[lo:hi])
        if not found:
            return
        y = np.concatenate(ys)
        order = np.argsort(np.array(keys), kind="stable")  # the order of arrival must not matter
        # a feature of one document only can't be learned from: its weight would be that document's label
        seen = np.zeros(1 << BITS, np.int32)
        for x in found:
            seen[x] += 1
        for i, x in enumerate(found):  # in place: two copies of all documents' features would be held otherwise
            found[i] = x[seen[x] > 1]
        found = [found[i] for i in order]
        y = y[order]
        model = ftrl(found, y, np.where(y == 1, share[1], share[0]) / scale)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.features], pa.list_(pa.int64())), pa.array([model.weights], pa.list_(pa.float64()))], names=["bias", "features", "weights"])

    out = sample.repartition(1).sortWithinPartitions("i").mapInArrow(B.trimmed(learn), "bias double, features array<long>, weights array<double>").collect()  # one row
    if not out:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.array(out[0]["features"], np.int64), np.array(out[0]["weights"]), out[0]["bias"])


def score_column(spark, model: Model):
    """A column function: text -> score in 0..1. Null and empty texts get the score of the bias."""
    shared = spark.sparkContext.broadcast((model.features, model.weights, model.bias))
    cache: dict[str, np.ndarray] = {}

    @F.arrow_udf("double")  # the texts stay in one buffer
    def score(text: pa.Array) -> pa.Array:
        feats, weights, bias = shared.value
        if "w" not in cache:
            B.forget(__name__)
            w = np.zeros(1 << BITS, np.float32)
            w[feats] = weights
            cache["w"] = w
        out = np.full(len(text), bias)
        for lo, hi, row, f in features(text):
            hit = cache["w"][f] != 0
            pairs = np.unique(row[hit] * (1 << BITS) + f[hit])  # a feature counts once a document
            out[lo:hi] += np.bincount(pairs >> BITS, weights=cache["w"][pairs & ((1 << BITS) - 1)].astype(float), minlength=hi - lo)
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return score


def held_out(id_col: str = "doc_id"):
    """Rows that models must not learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, score_col: str = "_score", predicted_col: str = "_predicted") -> DataFrame:
    """docs with _score and _predicted; the model learns from labels of rows that are not held out.

    Null and empty texts are scored by the bias alone; rows with a null id are scored and never
    learned from; without usable labels every score is 0.5. Equal texts have equal scores, an
    empty table gives none. The two columns can be named; columns of their names are replaced.
    """
    model = fit(docs, labels.filter(~held_out()))
    out = docs.withColumn(score_col, score_column(docs.sparkSession, model)(F.col("text")))
    return out.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
