"""Readers: batched text, edge lists, binary edges, typed CSV files, logs."""

from skein.sources.edges import read_batched_text, read_bel, read_edge_list, to_adjacency
from skein.sources.logs import read_bench_logs, read_traffic_logs
from skein.sources.trade_csv import EDGE_COLUMNS, InputFiles, import_graph, read_commercial, read_cyber, read_nodes, read_social, read_uses

__all__ = [
    "EDGE_COLUMNS", "InputFiles", "import_graph", "read_batched_text", "read_bel", "read_bench_logs", "read_commercial", "read_cyber",
    "read_edge_list", "read_nodes", "read_social", "read_traffic_logs", "read_uses", "to_adjacency",
]
