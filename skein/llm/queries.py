"""The registered queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm.oracles import SQL as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(ORACLES)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op7_ngram_join")
def op7(spark, sf):
    from skein.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf, "documents"), k=4, num=85, den=100)


@query("op8_substring_dedup")
def op8(spark, sf):
    from pyspark.sql import functions as F

    from skein.llm.substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op3_line_dedup")
def op3(spark, sf):
    from pyspark.sql import functions as F

    from skein.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf, "documents"), k=1, num=4, den=5)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_toxicity")
def op2(spark, sf):
    from skein.llm.toxicity import held_out, score_documents

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = score_documents(docs, table(spark, sf, "labels"), threshold=0.3)
    return out.select("doc_id", held_out().alias("held_out"), out["_score"].alias("score"), out["_predicted"].alias("predicted"))


@query("op6_language_id")
def op6(spark, sf):
    from skein.llm.language_id import identify
    from skein.llm.toxicity import held_out

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), out["_lang"].alias("lang_pred"), out["_score"].alias("score"))


@query("op1_chat_format")
def op1(spark, sf):
    from skein.llm.chat_format import format_conversations, read_back

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)))


@query("op5_best_fit_packing")
def op5(spark, sf):
    import public_tokenizers

    from skein.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query("op10_sharding")
def op10(spark, sf):
    from pyspark.sql import functions as F

    from skein.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_embedding_dedup")
def op4(spark, sf):
    from skein.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "embeddings"), threshold=0.93)


@query("op9_decontaminate")
def op9(spark, sf):
    from skein.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=5, similarity=0.8)
