"""Cancelling traders and rebalancing what they leave behind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.runtime import Scratch


def cancel_nodes(values: DataFrame, trade_edges: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Node values after the ids in `cancelled` stop trading.

    A sale c->d lowers d's bought, a purchase c->s lowers s's sold; the cancelled end at zero,
    and everyone's desired stays but theirs.
    """
    gone = cancelled.select("id").distinct()
    own = trade_edges.join(gone.select(F.col("id").alias("src")), "src", "left_semi")
    part = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(F.col("amount") * 0))
    lost = own.groupBy(F.col("dst").alias("id")).agg(part("SALE").alias("_b"), part("PURCHASE").alias("_s"))
    flagged = values.join(lost, "id", "left").join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    zero = lambda c, less: F.when(F.col("_gone"), F.col(c) * 0).otherwise(F.col(c) - F.coalesce(F.col(less), F.col(c) * 0) if less else F.col(c)).alias(c)
    return flagged.select("id", zero("sold", "_s"), zero("bought", "_b"), zero("desired", None))


def _before(part: str, order: list[str], value: str):
    return F.coalesce(F.sum(value).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def propose(values: DataFrame, trade_edges: DataFrame) -> DataFrame:
    """(buyer, seller, ord, amount): what each buyer asks of its sellers, in adjacency order.

    All read the same snapshot. Parallel purchases collapse to the first, sellers without
    surplus are skipped, and a running sum of surplus tells what is still needed.
    """
    needy = values.filter(F.col("desired") > F.col("bought")).select(F.col("id").alias("buyer"), (F.col("desired") - F.col("bought")).alias("need"))
    rich = values.filter(F.col("bought") > F.col("sold")).select(F.col("id").alias("seller"), (F.col("bought") - F.col("sold")).alias("surplus"))
    links = trade_edges.filter(F.col("type") == "PURCHASE").select(F.col("src").alias("buyer"), F.col("dst").alias("seller"), "edge_id").join(needy, "buyer")
    links = links.groupBy("buyer", "seller", "need").agg(F.min("edge_id").alias("ord")).join(rich, "seller")
    taken = links.withColumn("_had", _before("buyer", ["ord"], "surplus"))
    amount = F.greatest(F.col("need") * 0, F.least(F.col("surplus"), F.col("need") - F.col("_had")))
    return taken.select("buyer", "seller", "ord", amount.alias("amount")).filter("amount > 0")


def admit(values: DataFrame, proposals: DataFrame) -> DataFrame:
    """(buyer, seller, amount): what sellers grant, to buyers in id order until the surplus is used up."""
    rich = values.select(F.col("id").alias("seller"), F.greatest(F.col("bought") - F.col("sold"), F.col("bought") * 0).alias("surplus"))
    rows = proposals.join(rich, "seller").withColumn("_had", _before("seller", ["buyer"], "amount"))
    granted = F.greatest(F.col("amount") * 0, F.least(F.col("amount"), F.col("surplus") - F.col("_had")))
    return rows.select("buyer", "seller", granted.alias("amount")).filter("amount > 0")


def apply_trades(values: DataFrame, trades: DataFrame) -> DataFrame:
    """Sellers have sold, buyers have bought."""
    sold = trades.groupBy(F.col("seller").alias("id")).agg(F.sum("amount").alias("_s"))
    bought = trades.groupBy(F.col("buyer").alias("id")).agg(F.sum("amount").alias("_b"))
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.col(c) * 0)).alias(c)
    return values.join(sold, "id", "left").join(bought, "id", "left").select("id", plus("sold", "_s"), plus("bought", "_b"), "desired")


def quiesce(values: DataFrame, trade_edges: DataFrame, rounds: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """(values, trades) after so many propose/admit/apply rounds; None: until nothing is granted."""
    scratch = Scratch(values.sparkSession)
    state, trades, done = scratch.cut(values), None, 0
    while rounds is None or done < rounds:
        granted = scratch.cut(admit(state, propose(state, trade_edges)))
        done += 1
        now = granted.withColumn("round", F.lit(done))
        trades = now if trades is None else trades.unionByName(now)
        if granted.isEmpty():
            break
        state = scratch.cut(apply_trades(state, granted))
    return state, trades


def quiesce_serial(values: DataFrame, trade_edges: DataFrame) -> DataFrame:
    """(buyer, seller, amount) when buyers act one after another, in id order, with immediate effect.

    The semantics are sequential, so one task walks the needy buyers' links; only links of
    buyers with a need are sent to it. Meant for checking small networks.
    """
    needy = values.filter(F.col("desired") > F.col("bought")).select(F.col("id").alias("src"))
    links = trade_edges.filter(F.col("type") == "PURCHASE").join(needy, "src", "left_semi").select("src", "dst", "edge_id")
    v = values.select(F.lit(0).alias("g"), "id", F.col("sold").cast("double").alias("sold"), F.col("bought").cast("double").alias("bought"), F.col("desired").cast("double").alias("desired"))
    e = links.select(F.lit(0).alias("g"), "src", "dst", "edge_id")

    def walk(links: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        sold, bought, want = (dict(zip(nodes["id"], nodes[c], strict=True)) for c in ("sold", "bought", "desired"))
        out, seen = [], set()
        for b, s, _ in links.sort_values(["src", "edge_id"])[["src", "dst", "edge_id"]].itertuples(index=False):
            delta = min(want[b] - bought[b], bought[s] - sold[s])
            if delta > 0 and (b, s) not in seen:
                seen.add((b, s))
                sold[s] += delta
                bought[b] += delta
                out.append((b, s, delta))
        return pd.DataFrame(out, columns=["buyer", "seller", "amount"])

    return e.groupBy("g").cogroup(v.groupBy("g")).applyInPandas(walk, "buyer long, seller long, amount double")


def state_violations(values: DataFrame, slack: float = 0.01) -> DataFrame:
    """(id, reason): buyers that sold more than they bought, or bought more than they wanted."""
    over_sold = (F.col("bought") > 0) & (F.col("sold") > F.col("bought") + slack)
    over_bought = F.col("bought") > F.col("desired") + slack
    reasons = F.filter(F.array(F.when(over_sold, F.lit("sold")), F.when(over_bought, F.lit("bought"))), lambda x: x.isNotNull())
    return values.select("id", F.explode(reasons).alias("reason"))
