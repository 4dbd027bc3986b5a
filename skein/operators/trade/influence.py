"""Edge probabilities, random reverse reachable sets and greedy coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.draws import P, draw
from skein.functions.ordered import numbered
from skein.runtime import Scratch


def node_values(nodes: DataFrame, trade_edges: DataFrame) -> DataFrame:
    """(id, sold, bought, desired): sums over a node's own SALE and PURCHASE edges."""
    part = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(F.col("amount") * 0))
    sums = trade_edges.groupBy(F.col("src").alias("id")).agg(part("SALE").alias("sold"), part("PURCHASE").alias("bought"))
    zero = lambda c: F.coalesce(F.col(c), F.col(c) * 0, F.lit(0)).alias(c)
    return nodes.select("id").join(sums, "id", "left").select("id", zero("sold"), zero("bought"), zero("bought").alias("desired"))


def with_seller_total(trade_edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with `total`: what the edge's seller (src of a SALE, dst of a PURCHASE) sells in all."""
    seller = F.when(F.col("type") == "SALE", F.col("src")).otherwise(F.col("dst"))
    return trade_edges.withColumn("_seller", seller).join(values.select(F.col("id").alias("_seller"), F.col("sold").alias("total")), "_seller", "left").drop("_seller")


def edge_probability(trade_edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with `weight` = amount / seller's total, 0 where the seller sells nothing."""
    e = with_seller_total(trade_edges.drop("weight"), values)
    return e.withColumn("weight", F.when(F.col("total") > 0, F.col("amount") / F.col("total")).otherwise(F.lit(0.0)))


def probability_totals(weighted: DataFrame) -> DataFrame:
    """(total_weight, total_sales); sales count on both of their edges."""
    return weighted.agg(F.sum("weight").alias("total_weight"), F.sum("amount").alias("total_sales"))


def rrr_roots(nodes: DataFrame, sets: int, seed: int) -> DataFrame:
    """(set_id, node): a uniform root for each set, from the nodes in id order."""
    ranked = numbered(nodes.select("id"), ["id"], "_rn")
    n = ranked.count()
    if not n:
        return nodes.sparkSession.createDataFrame([], "set_id long, node long")
    picks = nodes.sparkSession.range(sets).select(F.col("id").alias("set_id"), F.pmod(draw(seed, F.col("id"), F.lit(0).cast("long")), F.lit(n)).alias("_rn"))
    return picks.join(ranked, "_rn").select("set_id", F.col("id").alias("node"))


def rrr_sets(nodes: DataFrame, weighted: DataFrame, sets: int, seed: int, max_rounds: int = 100) -> DataFrame:
    """(set_id, node): random reverse reachable sets.

    An edge is live in a set iff its draw is at most its probability, one draw for each
    (set, edge): the closure does not depend on visiting order, so a frontier loop gives it.
    Rounds beyond `max_rounds` are cut off; nodes reached by then stay.
    """
    scratch = Scratch(nodes.sparkSession)
    live = scratch.cut(weighted.filter((F.col("total") > 0) & (F.col("amount") > 0)).select(F.col("src").alias("node"), "dst", "edge_id", "amount", "total"))
    reached = scratch.cut(rrr_roots(nodes, sets, seed))
    frontier = reached
    hit = draw(seed + 1, F.col("set_id"), F.col("edge_id")) * F.col("total") <= F.col("amount") * F.lit(P)
    for _ in range(max_rounds):
        step = frontier.join(live, "node").filter(hit).select("set_id", F.col("dst").alias("node")).distinct()
        new = scratch.cut(step.join(reached, ["set_id", "node"], "left_anti"))
        if new.isEmpty():
            break
        old, reached = reached, scratch.cut(reached.unionByName(new))
        scratch.drop(old)
        frontier = new
    return reached


def frequency(sets: DataFrame) -> DataFrame:
    """(node, frequency): in how many sets a node is."""
    return sets.groupBy("node").agg(F.count(F.lit(1)).alias("frequency"))


def most_influential(sets: DataFrame) -> DataFrame:
    """(node, frequency) of the first node by frequency, then id."""
    return frequency(sets).orderBy(F.desc("frequency"), "node").limit(1)


def total_influence(sets: DataFrame) -> DataFrame:
    return frequency(sets).agg(F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("influence"))


def greedy_influencers(sets: DataFrame, k: int, every: int = 16) -> tuple[DataFrame, DataFrame]:
    """((pick, node, frequency), sets left uncovered): greedy coverage with k picks.

    After a pick (but the last) its sets go: their ids join a table of covered sets, and the
    frequencies are kept up by subtracting what they held. The table of sets is only read; it is
    rewritten without the covered ones once in `every` picks. It ends early when no node has a
    set left.
    """
    spark, scratch = sets.sparkSession, Scratch(sets.sparkSession)
    left = scratch.cut(sets.select("set_id", "node").distinct())
    covered = None
    counts = scratch.cut(frequency(left))
    picks: list[tuple[int, int, int]] = []
    for i in range(k):
        best = counts.filter("frequency > 0").orderBy(F.desc("frequency"), "node").limit(1).collect()  # one row
        if not best:
            break
        picks.append((i, best[0]["node"], best[0]["frequency"]))
        if i == k - 1:
            break
        gone = left.filter(F.col("node") == best[0]["node"]).select("set_id")
        gone = scratch.cut(gone if covered is None else gone.join(covered, "set_id", "left_anti"))
        lost = left.join(gone, "set_id", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("lost"))
        new_counts = scratch.cut(counts.join(lost, "node", "left").select("node", (F.col("frequency") - F.coalesce("lost", F.lit(0))).cast("long").alias("frequency")))
        scratch.drop(counts)
        counts = new_counts
        covered = gone if covered is None else covered.unionByName(gone)
        if (i + 1) % every == 0:
            new_left = scratch.cut(left.join(covered, "set_id", "left_anti"))
            scratch.drop(left)
            left, covered = new_left, None
    if covered is not None:
        left = left.join(covered, "set_id", "left_anti")
    return spark.createDataFrame(picks, "pick int, node long, frequency long"), left


def uninfluenced_sets(left: DataFrame) -> DataFrame:
    return left.agg(F.count_distinct("set_id").alias("uninfluenced"))


def picks_above(picks: DataFrame, threshold: int, share: float = 0.1) -> bool:
    """True if more than `share` of the picks have an id above the threshold."""
    row = picks.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("node") > threshold).cast("int")).alias("above")).first()
    return bool(row["n"]) and row["above"] > share * row["n"]
