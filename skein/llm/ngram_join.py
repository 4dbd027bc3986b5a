"""N-gram Jaccard join of documents (operator 7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm.components import components
from skein.llm.setjoin import NO_ID, Ratio, SetJoin


def document_records(k: int):
    """Each row's k-word shingles of the text with A-Z in lower case."""

    def records(batch):
        for lo, hi, b, off in B.blocks(batch.column(1)):
            s, e, first = B.word_spans(b, off)
            h, start = B.shingles(B.word_hashes(B.LOWER[b], s, e), first, k)
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int32), h, start

    return records


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) under names of our own; a null id counts as the smallest LONG."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("doc"), F.col(text_col).alias("text"))


def original_id(c: str, name: str):
    return F.when(F.col(c) != NO_ID, F.col(c)).alias(name)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by Jaccard >= num/den of their k-word shingle sets.

    One row per input row. component_id is the smallest id that links reach, the row's own
    included. Null and empty texts have no shingles and link with nothing; texts of fewer than k
    words have their whole sequence as one shingle; rows that repeat an id count on their own;
    a null id is smaller than all others; other columns are ignored; an empty table gives none.
    """
    join = SetJoin(prepared(docs, id_col, text_col), document_records(k), Ratio(num, den)).run()
    cut = join.scratch.cut
    stars = cut(join.star_candidates())
    links = join.verified(stars)
    groups = cut(components(links, join.scratch).select(F.col("node").alias("cid"), F.col("root").alias("grp")))
    rest = cut(join.rest_candidates(groups, stars, either=True))
    roots = groups.select(F.col("cid").alias("node"), F.col("grp").alias("root"))
    if not rest.isEmpty():
        roots = cut(components(links.unionByName(join.verified(rest)), join.scratch))
    named = join.classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "doc", F.coalesce("root", "cid").alias("root"))
    named = cut(named)
    label = cut(named.groupBy("root").agg(F.min("doc").alias("component")))
    by_class = cut(named.join(label, "root").select("cid", "component"))
    out = join.members.join(by_class, "cid", "left")
    return out.select(original_id("doc", "doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.coalesce("component", "doc") != NO_ID, F.coalesce("component", "doc")).alias("component_id"))
