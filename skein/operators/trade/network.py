"""Projection of the property graph to one commodity, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the commodity that the workflow trades.
COMMODITY = 8486


def is_trade(topic) -> Column:
    return F.col("type").isin("SALE", "PURCHASE") & (F.col("topic") == topic) & (F.col("amount") > 0)


def project_edges(nodes: DataFrame, edges: DataFrame, topic=COMMODITY) -> DataFrame:
    """Trade edges of the commodity whose two ends are persons of the node table."""
    persons = nodes.filter(F.col("type") == "PERSON").select("id").distinct()
    kept = edges.filter(is_trade(topic) & (F.col("src_type") == "PERSON") & (F.col("dst_type") == "PERSON"))
    ends = lambda c: persons.select(F.col("id").alias(c))
    kept = kept.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    extra = [c for c in ("edge_id",) if c in edges.columns]
    return kept.select(*extra, "type", "src", "dst", "amount", F.lit(0.0).alias("weight"))


def project_nodes(nodes: DataFrame, trade_edges: DataFrame) -> DataFrame:
    """(id) of the persons that keep an edge."""
    ends = trade_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.filter(F.col("type") == "PERSON").select("id").distinct().join(ends, "id", "left_semi")


def graph_statistics(nodes: DataFrame, edges: DataFrame, topic=COMMODITY) -> DataFrame:
    """One row: nodes, edges, trading persons, trading edges, trading edges that leave a person."""
    trade = is_trade(topic)
    from_person = trade & (F.col("src_type") == "PERSON")
    e = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_distinct(F.when(from_person, F.col("src"))).alias("trading_persons"),
        F.coalesce(F.sum(F.when(trade, 1).otherwise(0)), F.lit(0)).alias("trading_edges"),
        F.coalesce(F.sum(F.when(from_person, 1).otherwise(0)), F.lit(0)).alias("person_trading_edges"),
    )
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e)  # one row by one row
