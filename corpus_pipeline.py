"""A training corpus from raw documents, in five stages.

toxicity (rejected documents go) -> line dedup (later near-duplicate lines go, and documents of
which no line is left) -> n-gram Jaccard join (the smallest id of each group stays) -> benchmark
decontamination (documents that hold an item go) -> best-fit packing. Every stage reads what the
one before wrote as Parquet; all but the last return the columns of `documents`.

Null ids and texts pass the filters (nothing speaks against them), an empty table gives empty
results, and extra columns travel along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.blocks import free_name
from skein.llm.decontaminate import find_leaks
from skein.llm.line_dedup import dedup_lines
from skein.llm.ngram_join import ngram_join
from skein.llm.packing import pack_documents
from skein.llm.toxicity import score_documents
from skein.runtime import Scratch

REJECT = 0.3  # score from which a document counts as toxic
CAPACITY = 1024

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT."""
    score, predicted = free_name("_score", docs), free_name("_predicted", docs)
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT, score, predicted)
    return scored.filter(F.col(score) < REJECT).drop(score, predicted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later near-duplicate lines (sets of words, Jaccard 0.8); n_chars follows the text."""
    lines, removed = free_name("_n_lines", docs), free_name("_n_removed", docs)
    out = dedup_lines(docs, k=1, num=4, den=5, lines_col=lines, removed_col=removed)
    out = out.filter((F.col(removed) == 0) | (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "") | F.col("text").isNull())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(lines, removed)


def row_key() -> Column:
    """A hash of id and text: rows of one key repeat each other."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text")


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows are told apart by id and text. A null id is the smallest, and all rows without an id
    pass. Of rows that repeat a group's smallest id, or an id and its text, one stays.
    """
    scratch = Scratch(spark)
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    groups = ngram_join(keyed.select("key", "text"), id_col="key", k=5, num=80, den=100).select(F.col("doc_id").alias("key"), F.col("component_id").alias("grp"))
    groups = scratch.cut(groups.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n")))
    ids = groups.join(keyed.select("key", "id").distinct(), "key")
    kept = ids.groupBy("grp").agg(F.min(F.struct("id", "key", "n")).alias("k")).select("k.*")
    kept = scratch.cut(kept.filter("id is not null"))
    # most rows stay: the few keys that go are joined, so that the texts need no shuffle for it
    gone = scratch.cut(groups.select("key").join(kept.select("key"), "key", "left_anti").select(F.col("key").alias("_gone")))
    out = docs.filter(F.col("doc_id").isNotNull()).join(gone, row_key() == gone["_gone"], "left_anti")
    # a distinct over texts runs only if there are rows that repeat an id and its text
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; the text alone decides."""
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    leaks = find_leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", k=5, similarity=0.8)
    gone = leaks.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.xxhash64("text") == gone["_gone"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end_id=2)


def shrunk(stage: Stage) -> Stage:
    """`stage`, before which the executors give back the heap that the stages before it have widened."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch(spark).shrink()
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, shrunk(f)) for name, f in (("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_dedup), ("decontamination", decontamination), ("packing", packing))]

#: The stages hold learned and iterative steps that SQL cannot express; tests check them instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
