"""The trade-network workflow: project, value, sample, select, cancel, rebalance."""

from skein.operators.trade.influence import edge_probability, frequency, greedy_influencers, most_influential, node_values, probability_totals, rrr_roots, rrr_sets
from skein.operators.trade.network import graph_statistics, project_edges, project_nodes
from skein.operators.trade.rebalance import admit, apply_trades, cancel_nodes, propose, quiesce, quiesce_serial, state_violations
from skein.operators.trade.workflow import WorkflowConfig, run_workflow

__all__ = [
    "WorkflowConfig", "admit", "apply_trades", "cancel_nodes", "edge_probability", "frequency", "graph_statistics", "greedy_influencers",
    "most_influential", "node_values", "probability_totals", "project_edges", "project_nodes", "propose", "quiesce", "quiesce_serial",
    "rrr_roots", "rrr_sets", "run_workflow", "state_violations",
]
