"""The whole workflow behind one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ordered import numbered
from skein.operators.trade import influence as inf
from skein.operators.trade import network as net
from skein.operators.trade import rebalance as qui
from skein.runtime import Scratch
from skein.sources.trade_csv import InputFiles, import_graph


@dataclass
class WorkflowConfig:
    """Options; the defaults are fixed values of the command line."""

    k: int = 100
    rrr: int = 100_000
    seed: int = 98011089
    epochs: int = 100
    topic: object = net.COMMODITY
    quiesce_rounds: int | None = 1

    def __post_init__(self):
        if self.k <= 0 or self.rrr <= 0:
            raise ValueError("k and rrr must be positive")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """Edges with an edge_id of their own each, 0.. in adjacency order: equal parallel sales stay apart."""
    return numbered(edges, [c for c in ("src", "dst", "type", "amount", "date") if c in edges.columns], "edge_id")


def run_workflow(spark: SparkSession, source: InputFiles | tuple[DataFrame, DataFrame], cfg: WorkflowConfig | None = None) -> dict[str, DataFrame]:
    """import -> project -> probabilities -> reverse sets -> influencers -> cancel -> quiesce."""
    cfg = cfg or WorkflowConfig()
    scratch = Scratch(spark)
    nodes, edges = import_graph(spark, source) if isinstance(source, InputFiles) else source
    stats = net.graph_statistics(nodes, edges, cfg.topic)
    if "edge_id" not in edges.columns:
        edges = numbered_edges(edges)
    trade = scratch.cut(net.project_edges(nodes, edges, cfg.topic))
    traders = scratch.cut(net.project_nodes(nodes, trade))
    values = scratch.cut(inf.node_values(traders, trade))
    weighted = scratch.cut(inf.edge_probability(trade, values))
    sets = inf.rrr_sets(traders, weighted, cfg.rrr, cfg.seed, cfg.epochs)
    picks, left = inf.greedy_influencers(sets, cfg.k)
    after = qui.cancel_nodes(values, trade, picks.select(F.col("node").alias("id")))
    state, trades = qui.quiesce(after, trade, cfg.quiesce_rounds)
    return {"statistics": stats, "edges": weighted, "values": values, "sets": sets, "influencers": picks, "uninfluenced": inf.uninfluenced_sets(left), "state": state, "trades": trades, "violations": qui.state_violations(state)}
