"""Graphs derived from the star-schema tables: TRADE, INFL, TYPED and EVT, as DataFrames and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.draws import edge_key
from skein.functions.ordered import numbered, with_next
from skein.sources.trade_csv import sale_pairs

TOPIC = "R"
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
#: Rows of a table that one task sorts or groups, about.
ROWS = 1 << 19


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in partitions that grow in number with `rows`, not in size."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    return df.repartition(n, *keys)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """(sale_id, custkey, suppkey, partkey, amount, topic): one row per line item."""
    li = table(spark, sf, "lineitem")
    n = li.count()
    parts = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"), F.date_format("l_shipdate", "yyyyMMddHHmmss")]
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("amount"), F.col("l_returnflag").alias("topic"), edge_key(*[p.cast("string") for p in parts]).alias("sale_id"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    return spread(rows, n, "l_orderkey").join(spread(orders, n, "l_orderkey"), "l_orderkey").select("sale_id", "custkey", F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"), "amount", "topic")


def _both(rows: DataFrame) -> DataFrame:
    pairs = sale_pairs(rows)
    edge_id = F.when(F.col("type") == "SALE", F.col("sale_id") * 2).otherwise(F.col("sale_id") * 2 + 1)
    return pairs.select(edge_id.alias("edge_id"), "type", F.lit("PERSON").alias("src_type"), "src", F.lit("PERSON").alias("dst_type"), "dst", "topic", "amount")


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers sell to suppliers."""
    return _both(sales(spark, sf).select("sale_id", F.col("custkey").alias("src"), F.col("suppkey").alias("dst"), "amount", "topic"))


def infl_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers sell to groups of seven customers."""
    buyer = F.expr("1000000 + custkey div 7")
    return _both(sales(spark, sf).filter(F.col("topic") == TOPIC).select("sale_id", F.col("suppkey").alias("src"), buyer.alias("dst"), "amount", "topic"))


def persons(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.select(F.lit("PERSON").alias("type"), "id")


def _typed(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, int, str, str]]:
    """type -> (edges as (src, dst), rows at most, src_type, dst_type); PURCHASE is SALE the other way."""
    from pyspark.sql import Window as W

    sold = sales(spark, sf)
    li = table(spark, sf, "lineitem").select(*_KEY)
    n = li.count()
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*_KEY[1:]))
    comm = spread(li, n, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null")
    friend = event_edges(spark, sf).select("src", "dst")
    return {
        "SALE": (sold.select(F.col("custkey").alias("src"), F.col("suppkey").alias("dst")), n, "PERSON", "PERSON"),
        "USES": (sold.select(F.col("custkey").alias("src"), F.col("partkey").alias("dst")), n, "PERSON", "DEVICE"),
        "COMMUNICATION": (comm.select("src", "dst"), n, "DEVICE", "DEVICE"),
        "FRIEND": (friend, table(spark, sf, "events").count(), "PERSON", "PERSON"),
    }


def _named(kind: str, rows: DataFrame, src_type: str, dst_type: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("src", "dst")]
    pairs = sale_pairs(rows) if kind == "SALE" else rows.select(F.lit(kind).alias("type"), "src", "dst", *rest)
    return pairs.select("type", F.lit(src_type).alias("src_type"), "src", F.lit(dst_type).alias("dst_type"), "dst", *rest)


def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(type, src_type, src, dst_type, dst): trade, uses, communication and friend edges together."""
    return reduce(DataFrame.unionByName, (_named(kind, rows, a, b) for kind, (rows, _, a, b) in _typed(spark, sf).items()))


def typed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct typed_edges with their number `n`, each kind counted by itself on its ids only."""
    counted = lambda rows, n: spread(rows, n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, (_named(kind, counted(rows, n), a, b) for kind, (rows, n, a, b) in _typed(spark, sf).items()))


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(edge_idx, src, dst): user to the next event's user, without self loops, in time order."""
    ev = table(spark, sf, "events").select("ts", "event_id", "user_id")
    pairs = with_next(ev, ["ts", "event_id"], "user_id", "dst").filter((F.col("dst").isNotNull()) & (F.col("user_id") != F.col("dst")))
    return numbered(pairs.select("ts", "event_id", F.col("user_id").alias("src"), "dst"), ["ts", "event_id"], "edge_idx").select("edge_idx", "src", "dst")


# The same graphs as common table expressions.
_ID = "('0x' || substr(md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_quantity::BIGINT::VARCHAR, strftime(l_shipdate, '%Y%m%d%H%M%S'))), 1, 15))::BIGINT"
SALES = f"sales AS MATERIALIZED (SELECT {_ID} AS sale_id, o_custkey AS custkey, l_suppkey AS suppkey, l_partkey AS partkey, l_quantity::BIGINT AS amount, l_returnflag AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _pairs_sql(name: str, src: str, dst: str, where: str = "") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT sale_id * 2 AS edge_id, 'SALE' AS type, {src} AS src, {dst} AS dst, topic, amount FROM sales {where} "
        f"UNION ALL SELECT sale_id * 2 + 1, 'PURCHASE', {dst}, {src}, topic, amount FROM sales {where})"
    )


TRADE = SALES + ", " + _pairs_sql("trade_all", "custkey", "suppkey")
TRADE_R = TRADE + f", trade AS MATERIALIZED (SELECT * FROM trade_all WHERE topic = '{TOPIC}' AND amount > 0)"
INFL = SALES + ", " + _pairs_sql("trade", "suppkey", "1000000 + custkey // 7", f"WHERE topic = '{TOPIC}'")
EVT = (
    "evt0 AS (SELECT ts, event_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events), "
    "evt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS edge_idx, src, dst FROM evt0 WHERE dst IS NOT NULL AND src <> dst)"
)
VALUES = (
    "nodes AS MATERIALIZED (SELECT src AS id FROM trade UNION SELECT dst FROM trade), "
    "vals AS MATERIALIZED (SELECT id, coalesce(sum(amount) FILTER (WHERE type = 'SALE'), 0)::BIGINT AS sold, coalesce(sum(amount) FILTER (WHERE type = 'PURCHASE'), 0)::BIGINT AS bought, "
    "coalesce(sum(amount) FILTER (WHERE type = 'PURCHASE'), 0)::BIGINT AS desired FROM nodes LEFT JOIN trade ON src = id GROUP BY id)"
)
WEIGHTED = "weighted AS MATERIALIZED (SELECT t.*, v.sold AS total FROM trade t JOIN vals v ON v.id = CASE WHEN t.type = 'SALE' THEN t.src ELSE t.dst END)"
