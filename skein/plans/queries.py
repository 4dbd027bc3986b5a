"""Registered queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.draws import P, draw_sql
from skein.operators import batches as bt
from skein.operators import tools
from skein.operators.betweenness import betweenness
from skein.operators.bfs import bfs_levels
from skein.operators.pagerank import TOLERANCE, pagerank
from skein.operators.store import GraphStore
from skein.operators.trade import influence as inf
from skein.operators.trade import network as net
from skein.operators.trade import rebalance as qui
from skein.operators.triangles import triangle_count
from skein.plans import graphs as g
from skein.runtime import Scratch
from skein.sinks import batched_lines, csr_destinations, csr_offsets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SETS, SEED, ROUNDS = 1000, 9801, 100
CANCELLED = [0, 1, 2]
BATCHES, STARTUP = 4, 0.5
SOURCES = [0, 3, 7]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _size(edges: DataFrame) -> int:
    return (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1


# -- sources and node tables --------------------------------------------------------------


@query("sale_edges", f"WITH {g.TRADE} SELECT edge_id, src, dst, topic, amount FROM trade_all WHERE type = 'SALE'")
def _(spark, sf):
    return g.trade_edges(spark, sf).filter("type = 'SALE'").select("edge_id", "src", "dst", "topic", "amount")


@query("purchase_edges", f"WITH {g.TRADE} SELECT edge_id, src, dst, topic, amount FROM trade_all WHERE type = 'PURCHASE'")
def _(spark, sf):
    return g.trade_edges(spark, sf).filter("type = 'PURCHASE'").select("edge_id", "src", "dst", "topic", "amount")


_TYPED = (
    f"{g.TRADE}, {g.EVT}, typed AS (SELECT type, 'PERSON' AS src_type, src, 'PERSON' AS dst_type, dst FROM trade_all "
    "UNION ALL SELECT 'USES', 'PERSON', custkey, 'DEVICE', partkey FROM sales "
    "UNION ALL SELECT 'COMMUNICATION', 'DEVICE', a, 'DEVICE', b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS b FROM lineitem) WHERE b IS NOT NULL "
    "UNION ALL SELECT 'FRIEND', 'PERSON', src, 'PERSON', dst FROM evt)"
)


@query("typed_edges", f"WITH {_TYPED} SELECT type, src_type, src, dst_type, dst, count(*) AS n FROM typed GROUP BY ALL")
def _(spark, sf):
    return g.typed_counts(spark, sf)


@query("node_extract", f"WITH {_TYPED} SELECT src_type AS type, src AS id FROM typed UNION SELECT dst_type, dst FROM typed")
def _(spark, sf):
    from skein.sources.trade_csv import extract_nodes

    return extract_nodes(g.typed_edges(spark, sf))


@query("device_uid", f"WITH {_TYPED} SELECT type, id, (CASE WHEN type = 'DEVICE' THEN 9223372036854775807::HUGEINT + id ELSE id::HUGEINT END)::VARCHAR AS uid FROM (SELECT src_type AS type, src AS id FROM typed UNION SELECT dst_type, dst FROM typed)")
def _(spark, sf):
    from skein.sources.trade_csv import extract_nodes, uid

    return extract_nodes(g.typed_edges(spark, sf)).select("type", "id", uid(F.col("type"), F.col("id")).cast("string").alias("uid"))


# -- graph storage ------------------------------------------------------------------------


@query("adjacency", f"WITH {g.EVT} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM evt GROUP BY src")
def _(spark, sf):
    from skein.sources.edges import to_adjacency

    return to_adjacency(g.event_edges(spark, sf)).select("src", F.concat_ws(",", F.transform("dsts", lambda x: x.cast("string"))).alias("dsts"))


@query("out_degree", f"WITH {g.EVT} SELECT src, count(*) AS degree FROM evt GROUP BY src")
def _(spark, sf):
    return tools.out_degrees(g.event_edges(spark, sf))


_N = "(SELECT max(greatest(src, dst)) + 1 FROM evt)"


@query("degree_zero_filled", f"WITH {g.EVT}, odd AS (SELECT * FROM evt WHERE src % 2 = 1) SELECT v AS vertex, count(odd.src) AS degree FROM (SELECT unnest(range({_N.replace('evt', 'odd')})) AS v) LEFT JOIN odd ON v = odd.src GROUP BY v")
def _(spark, sf):
    store = GraphStore(spark, "adj").commit(g.event_edges(spark, sf).select("src", "dst"))
    return store.out_degree()


@query("vertex_count", f"WITH {g.EVT} SELECT max(greatest(src, dst)) AS max_vertex, count(*) AS edges FROM evt")
def _(spark, sf):
    return tools.graph_counts(g.event_edges(spark, sf))


@query("csr_offsets", f"WITH {g.EVT} SELECT v AS vertex, degree, sum(degree) OVER (ORDER BY v)::BIGINT AS row_end FROM (SELECT v, count(evt.src) AS degree FROM (SELECT unnest(range({_N})) AS v) LEFT JOIN evt ON v = evt.src GROUP BY v)")
def _(spark, sf):
    e = g.event_edges(spark, sf)
    return csr_offsets(e, _size(e))


@query("csr_destinations", f"WITH {g.EVT} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS idx, dst FROM evt")
def _(spark, sf):
    return csr_destinations(g.event_edges(spark, sf))


@query("edge_exists", f"WITH {g.EVT} SELECT a.v AS src, b.v AS dst FROM (SELECT unnest(range(15)) AS v) a, (SELECT unnest(range(15)) AS v) b WHERE EXISTS (SELECT 1 FROM evt WHERE src = a.v AND dst = b.v)")
def _(spark, sf):
    store = GraphStore(spark, "csr").commit(g.event_edges(spark, sf).select("src", "dst"))
    edges = store.edges()
    pairs = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return store.find_edges(pairs)


# -- batches ------------------------------------------------------------------------------

_BATCHED = (
    f"{g.EVT}, tot AS (SELECT count(*) AS n, floor(count(*) * {STARTUP})::BIGINT AS pre FROM evt), "
    f"batched AS MATERIALIZED (SELECT evt.*, (CASE WHEN edge_idx < pre THEN -1 ELSE (edge_idx - pre) // greatest(1, ceil((n - pre) / {BATCHES}.0)::BIGINT) END)::INT AS batch FROM evt, tot)"
)


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    e = Scratch(spark).cut(g.event_edges(spark, sf))
    return bt.assign_batches(e, e.count(), BATCHES, STARTUP)


@query("batch_report", f"WITH {_BATCHED} SELECT batch, count(DISTINCT src) AS modified_vertices, count(*) AS edges FROM batched GROUP BY batch")
def _(spark, sf):
    return bt.batch_report(_batched(spark, sf))


@query("pre_ingest_split", f"WITH {_BATCHED} SELECT batch = -1 AS preloaded, min(edge_idx) AS first, max(edge_idx) AS last FROM batched GROUP BY 1")
def _(spark, sf):
    return _batched(spark, sf).groupBy((F.col("batch") == -1).alias("preloaded")).agg(F.min("edge_idx").alias("first"), F.max("edge_idx").alias("last"))


@query("batch_edges_sorted", f"WITH {_BATCHED} SELECT batch, src, src::VARCHAR || ' ' || string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS line FROM batched GROUP BY batch, src")
def _(spark, sf):
    return batched_lines(_batched(spark, sf))


@query("cumulative_graph_size", f"WITH {_BATCHED}, per AS (SELECT batch, max(greatest(src, dst)) + 1 AS top, count(*) AS n FROM batched GROUP BY batch) SELECT batch, max(top) OVER (ORDER BY batch) AS vertices, sum(n) OVER (ORDER BY batch)::BIGINT AS edges FROM per")
def _(spark, sf):
    from pyspark.sql import Window as W

    per = _batched(spark, sf).groupBy("batch").agg((F.max(F.greatest("src", "dst")) + 1).alias("top"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("batch")  # one row per batch
    return per.select("batch", F.max("top").over(w).alias("vertices"), F.sum("n").over(w).alias("edges"))


@query("first_batch_edges", f"WITH {_BATCHED} SELECT count(*) AS edges FROM batched WHERE batch = 0")
def _(spark, sf):
    return tools.first_batch_edges(_batched(spark, sf))


@query(
    "compaction_log",
    f"WITH RECURSIVE {_BATCHED}, per AS (SELECT batch + 1 AS b, count(*) AS n FROM batched GROUP BY batch), "
    "steps AS (SELECT 0 AS b, 0::BIGINT AS base_rows, (SELECT n FROM per WHERE b = 0) AS delta_rows UNION ALL "
    "SELECT s.b + 1, CASE WHEN s.delta_rows > 0.3 * s.base_rows THEN s.base_rows + s.delta_rows ELSE s.base_rows END, (CASE WHEN s.delta_rows > 0.3 * s.base_rows THEN 0 ELSE s.delta_rows END) + p.n FROM steps s JOIN per p ON p.b = s.b + 1) "
    "SELECT b AS batch, base_rows, delta_rows, delta_rows > 0.3 * base_rows AS compacted FROM steps",
)
def _(spark, sf):
    rows = Scratch(spark).cut(_batched(spark, sf))
    store = GraphStore(spark, "lscsr", 0.3)
    for b in range(-1, BATCHES):
        store.commit(rows.filter(F.col("batch") == b).select("src", "dst"))
    return spark.createDataFrame([(x["batch"], x["base_rows"], x["delta_rows"], x["compacted"]) for x in store.log], "batch int, base_rows long, delta_rows long, compacted boolean")


@query("vhost_load", f"WITH {g.EVT} SELECT v AS vhost, count(evt.src) AS load FROM (SELECT unnest(range(16)) AS v) LEFT JOIN evt ON evt.src % 16 = v GROUP BY v")
def _(spark, sf):
    return tools.vhost_load(g.event_edges(spark, sf), 16)


_LPT = (
    f"WITH RECURSIVE {g.EVT}, loads AS (SELECT v, count(evt.src) AS load FROM (SELECT unnest(range(16)) AS v) LEFT JOIN evt ON evt.src % 16 = v GROUP BY v), "
    "ranked AS MATERIALIZED (SELECT load, row_number() OVER (ORDER BY load DESC) AS i FROM loads), "
    "fill(i, l) AS (SELECT 0::BIGINT, [0, 0, 0, 0]::BIGINT[] UNION ALL SELECT fill.i + 1, list_transform(l, lambda x, j: CASE WHEN j = list_position(l, list_min(l)) THEN x + load ELSE x END) FROM fill JOIN ranked ON ranked.i = fill.i + 1) "
    "SELECT (generate_subscripts(l, 1) - 1)::INT AS host, unnest(l) AS load FROM fill WHERE i = 16"
)


@query("host_lpt", _LPT)
def _(spark, sf):
    return tools.pack_hosts(tools.vhost_load(g.event_edges(spark, sf), 16), 4)


@query("shuffled_edges", f"WITH {g.EVT} SELECT src, dst, count(*) AS n FROM evt GROUP BY src, dst")
def _(spark, sf):
    return tools.shuffle_edges(g.event_edges(spark, sf), 5).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _kron_sql(scale: int, seed: int) -> str:
    qs = ", ".join(f"{draw_sql(seed, str(b), 'edge_idx')} AS d{b}" for b in range(scale))
    cuts = [int(x * P) for x in (0.57, 0.57 + 0.19, 0.57 + 0.19 + 0.19)]
    q = lambda b: f"(CASE WHEN d{b} < {cuts[0]} THEN 0 WHEN d{b} < {cuts[1]} THEN 1 WHEN d{b} < {cuts[2]} THEN 2 ELSE 3 END)"
    src = " + ".join(f"({q(b)} // 2) * {1 << b}" for b in range(scale))
    dst = " + ".join(f"({q(b)} % 2) * {1 << b}" for b in range(scale))
    return f"SELECT edge_idx, ({src})::BIGINT AS src, ({dst})::BIGINT AS dst FROM (SELECT edge_idx, {qs} FROM (SELECT unnest(range({16 << scale})) AS edge_idx))"


@query("kron_edges", _kron_sql(8, 1))
def _(spark, sf):
    return tools.kronecker_edges(spark, 8, seed=1, permute=False)


# -- algorithms ---------------------------------------------------------------------------

_DEPTH = 8
_BFS = "{links} AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}), lv(vertex, level) AS (SELECT {source}, 0 UNION SELECT l.dst, level + 1 FROM lv JOIN {links} l ON l.src = vertex WHERE level < {depth})"


@query("bfs_levels", f"WITH RECURSIVE {g.EVT}, " + _BFS.format(links="links", edges="evt", source="0::BIGINT", depth=_DEPTH) + " SELECT vertex, min(level)::INT AS level FROM lv GROUP BY vertex")
def _(spark, sf):
    e = Scratch(spark).cut(g.event_edges(spark, sf))
    return bfs_levels(e, _size(e), 0)


@query("bfs_after_batch", f"WITH RECURSIVE {_BATCHED}, pre AS (SELECT * FROM batched WHERE batch <= 0), " + _BFS.format(links="links", edges="pre", source="1::BIGINT", depth=_DEPTH) + " SELECT vertex, min(level)::INT AS level FROM lv GROUP BY vertex")
def _(spark, sf):
    store = GraphStore(spark, "lscsr")
    rows = Scratch(spark).cut(_batched(spark, sf))
    for b in (-1, 0):
        store.commit(rows.filter(F.col("batch") == b).select("src", "dst"))
    return bfs_levels(store.edges(), store.size(), 1)


_SYM = f"{g.EVT}, sym AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM evt UNION ALL SELECT dst, src FROM evt))"
_TC = "up AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM {e} WHERE src < dst GROUP BY src, dst) SELECT coalesce(sum(a.m * b.m), 0)::BIGINT AS triangles FROM up a JOIN up b ON a.dst = b.src JOIN up c ON c.src = a.src AND c.dst = b.dst"


@query("triangle_count", f"WITH {_SYM}, " + _TC.format(e="sym"))
def _(spark, sf):
    e = Scratch(spark).cut(g.event_edges(spark, sf).select("src", "dst"))
    return triangle_count(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


@query("triangle_count_multigraph", f"WITH {g.EVT}, " + _TC.format(e="evt"))
def _(spark, sf):
    return triangle_count(g.event_edges(spark, sf))


@query(
    "triangle_count_per_batch",
    f"WITH {_BATCHED}, ks AS (SELECT unnest(range({BATCHES}))::INT AS batch), up AS MATERIALIZED (SELECT k.batch, src, dst, count(*) AS m FROM batched b JOIN ks k ON b.batch <= k.batch WHERE src < dst GROUP BY ALL) "
    "SELECT a.batch, sum(a.m * b.m)::BIGINT AS triangles FROM up a JOIN up b ON a.dst = b.src AND a.batch = b.batch JOIN up c ON c.src = a.src AND c.dst = b.dst AND c.batch = a.batch GROUP BY a.batch",
)
def _(spark, sf):
    rows = Scratch(spark).cut(_batched(spark, sf))
    part = lambda b: rows.filter(F.col("batch") == b).select("src", "dst")
    store, out = GraphStore(spark, "csr"), None
    for i, result, _ in bt.run_batches(store, [part(b) for b in range(BATCHES)], "tc", startup=part(-1)):
        row = spark.createDataFrame([(i, result.first()[0])], "batch int, triangles long")
        out = row if out is None else out.unionByName(row)
    return out


def _rank_sql(iterations: int, stop: float | None) -> str:
    parts = [g.EVT, f"n AS (SELECT {_N} AS n)", "od AS MATERIALIZED (SELECT src, count(*) AS deg FROM evt GROUP BY src)", "w AS MATERIALIZED (SELECT e.src, e.dst, count(*)::DOUBLE / max(deg) AS w FROM evt e JOIN od ON od.src = e.src GROUP BY e.src, e.dst)"]
    parts.append("r0 AS MATERIALIZED (SELECT v AS vertex, 1.0::DOUBLE / n AS rank, false AS stopped FROM (SELECT unnest(range(n)) AS v, n FROM n))")
    for i in range(iterations):
        keep = f"CASE WHEN p.stopped THEN p.rank ELSE 0.15::DOUBLE / n + 0.85 * coalesce(s.got, 0) END"
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT p.vertex, p.rank AS was, {keep} AS rank, p.stopped FROM r{i} p CROSS JOIN n LEFT JOIN (SELECT w.dst, sum(q.rank * w.w) AS got FROM w JOIN r{i} q ON q.vertex = w.src GROUP BY w.dst) s ON s.dst = p.vertex)")
        flag = f"stopped OR (SELECT sum(abs(rank - was)) FROM t{i + 1}) < {stop}" if stop else "false"
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT vertex, rank, {flag} AS stopped FROM t{i + 1})")
    return f"WITH {', '.join(parts)} SELECT vertex, round(rank, 9) AS rank FROM r{iterations}"


@query("pagerank_fixed10", _rank_sql(10, None))
def _(spark, sf):
    e = Scratch(spark).cut(g.event_edges(spark, sf))
    return pagerank(e, _size(e), iterations=10).select("vertex", F.round("rank", 9).alias("rank"))


@query("pagerank_converged", _rank_sql(14, TOLERANCE))
def _(spark, sf):
    e = Scratch(spark).cut(g.event_edges(spark, sf))
    return pagerank(e, _size(e)).select("vertex", F.round("rank", 9).alias("rank"))


def _bc_sql(depth: int) -> str:
    parts = [g.EVT, "links AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS m FROM evt GROUP BY src, dst)", f"s0 AS MATERIALIZED (SELECT s AS source, s AS vertex, 1.0::DOUBLE AS sigma FROM (SELECT unnest({SOURCES})::BIGINT AS s))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, vertex FROM s{i}" for i in range(d))
        parts.append(f"s{d} AS MATERIALIZED (SELECT p.source, l.dst AS vertex, sum(p.sigma * l.m) AS sigma FROM s{d - 1} p JOIN links l ON l.src = p.vertex WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.source = p.source AND z.vertex = l.dst) GROUP BY p.source, l.dst)")
    parts.append(f"b{depth} AS MATERIALIZED (SELECT source, vertex, sigma, 0.0::DOUBLE AS delta FROM s{depth})")
    for d in range(depth - 1, 0, -1):
        parts.append(f"b{d} AS MATERIALIZED (SELECT s.source, s.vertex, s.sigma, s.sigma * coalesce(x.gain, 0) AS delta FROM s{d} s LEFT JOIN (SELECT b.source, l.src, sum(l.m * (1 + b.delta) / b.sigma) AS gain FROM b{d + 1} b JOIN links l ON l.dst = b.vertex GROUP BY b.source, l.src) x ON x.source = s.source AND x.src = s.vertex)")
    total = " UNION ALL ".join(f"SELECT vertex, delta FROM b{d}" for d in range(1, depth + 1))
    return f"WITH {', '.join(parts)} SELECT v AS vertex, round(coalesce(sum(delta), 0), 6) AS score FROM (SELECT unnest(range({_N})) AS v) LEFT JOIN ({total}) ON vertex = v GROUP BY v"


@query("bc_sampled", _bc_sql(5))
def _(spark, sf):
    e = Scratch(spark).cut(g.event_edges(spark, sf))
    sources = spark.createDataFrame([(s,) for s in SOURCES], "source long")
    return betweenness(e, _size(e), sources).select("vertex", F.round("score", 6).alias("score"))


# -- trade workflow -----------------------------------------------------------------------


def _trade(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = g.trade_edges(spark, sf)
    nodes = g.persons(edges)
    trade = Scratch(spark).cut(net.project_edges(nodes, edges, g.TOPIC))
    return net.project_nodes(nodes, trade), trade


@query("project_edges", f"WITH {g.TRADE_R} SELECT edge_id, type, src, dst, amount FROM trade")
def _(spark, sf):
    return _trade(spark, sf)[1].select("edge_id", "type", "src", "dst", "amount")


@query("project_nodes", f"WITH {g.TRADE_R} SELECT src AS id FROM trade UNION SELECT dst FROM trade")
def _(spark, sf):
    return _trade(spark, sf)[0]


@query("node_values", f"WITH {g.TRADE_R}, {g.VALUES} SELECT * FROM vals")
def _(spark, sf):
    return inf.node_values(*_trade(spark, sf))


@query("edge_probability", f"WITH {g.TRADE_R}, {g.VALUES}, {g.WEIGHTED} SELECT edge_id, type, src, dst, round(CASE WHEN total > 0 THEN amount::DOUBLE / total ELSE 0 END, 9) AS weight FROM weighted")
def _(spark, sf):
    nodes, trade = _trade(spark, sf)
    return inf.edge_probability(trade, inf.node_values(nodes, trade)).select("edge_id", "type", "src", "dst", F.round("weight", 9).alias("weight"))


@query("probability_totals", f"WITH {g.TRADE_R}, {g.VALUES}, {g.WEIGHTED} SELECT round(sum(CASE WHEN total > 0 THEN amount::DOUBLE / total ELSE 0 END), 6) AS total_weight, sum(amount)::BIGINT AS total_sales FROM weighted")
def _(spark, sf):
    nodes, trade = _trade(spark, sf)
    return inf.probability_totals(inf.edge_probability(trade, inf.node_values(nodes, trade))).select(F.round("total_weight", 6).alias("total_weight"), "total_sales")


@query("graph_statistics", f"WITH {g.TRADE} SELECT (SELECT count(*) FROM (SELECT src FROM trade_all UNION SELECT dst FROM trade_all)) AS nodes, count(*) AS edges, count(DISTINCT src) FILTER (WHERE topic = 'R' AND amount > 0) AS trading_persons, count(*) FILTER (WHERE topic = 'R' AND amount > 0) AS trading_edges, count(*) FILTER (WHERE topic = 'R' AND amount > 0) AS person_trading_edges FROM trade_all")
def _(spark, sf):
    edges = g.trade_edges(spark, sf)
    return net.graph_statistics(g.persons(edges), edges, g.TOPIC)


_ROOTS = f"ranked AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn FROM nodes), roots AS MATERIALIZED (SELECT s AS set_id, id AS node FROM (SELECT unnest(range({SETS})) AS s) JOIN ranked ON rn = {draw_sql(SEED, 's', '0')} % (SELECT count(*) FROM nodes))"
_RRR = f"rrr(set_id, node) AS (SELECT set_id, node FROM roots UNION SELECT r.set_id, w.dst FROM rrr r JOIN weighted w ON w.src = r.node WHERE {draw_sql(SEED + 1, 'r.set_id', 'w.edge_id')} * w.total <= w.amount * {P})"
_INFL = f"WITH RECURSIVE {g.INFL}, {g.VALUES}, {g.WEIGHTED}, {_ROOTS}, {_RRR}"


def infl_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = Scratch(spark).cut(g.infl_edges(spark, sf))
    nodes = g.persons(edges)
    values = inf.node_values(nodes, edges)
    return nodes, inf.edge_probability(edges, values)


_SETS: dict[tuple[str, str], DataFrame] = {}


def infl_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The sets of INFL; one computation serves all queries of a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SETS:
        nodes, weighted = infl_graph(spark, sf)
        _SETS[key] = inf.rrr_sets(nodes, weighted, SETS, SEED, ROUNDS)
    return _SETS[key]


@query("rrr_roots", f"{_INFL} SELECT set_id, node FROM roots")
def _(spark, sf):
    return inf.rrr_roots(infl_graph(spark, sf)[0], SETS, SEED)


@query("rrr_sets", f"{_INFL} SELECT set_id, node FROM rrr")
def _(spark, sf):
    return infl_sets(spark, sf)


@query("rrr_frequency", f"{_INFL} SELECT node, count(*) AS frequency FROM rrr GROUP BY node")
def _(spark, sf):
    return inf.frequency(infl_sets(spark, sf))


@query("most_influential", f"{_INFL} SELECT node, count(*) AS frequency FROM rrr GROUP BY node ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark, sf):
    return inf.most_influential(infl_sets(spark, sf))


@query("total_influence", f"{_INFL} SELECT count(*) AS influence FROM rrr")
def _(spark, sf):
    return inf.total_influence(infl_sets(spark, sf))


def _greedy_sql(k: int) -> str:
    parts, left = ["a0 AS MATERIALIZED (SELECT * FROM rrr)"], "a0"
    for i in range(k):
        parts.append(f"p{i} AS MATERIALIZED (SELECT node, count(*) AS frequency FROM {left} GROUP BY node ORDER BY 2 DESC, 1 LIMIT 1)")
        if i < k - 1:
            parts.append(f"a{i + 1} AS MATERIALIZED (SELECT * FROM a{i} WHERE set_id NOT IN (SELECT set_id FROM a{i} WHERE node IN (SELECT node FROM p{i})))")
            left = f"a{i + 1}"
    return f"{_INFL}, {', '.join(parts)}"


@query("influencers_k3", _greedy_sql(3) + " " + " UNION ALL ".join(f"SELECT {i} AS pick, node, frequency FROM p{i}" for i in range(3)))
def influencers_k3(spark, sf):
    return inf.greedy_influencers(infl_sets(spark, sf), 3)[0]


@query("uninfluenced_sets", _greedy_sql(3) + " SELECT count(DISTINCT set_id) AS uninfluenced FROM a2")
def _(spark, sf):
    return inf.uninfluenced_sets(inf.greedy_influencers(infl_sets(spark, sf), 3)[1])


_GONE = f"({', '.join(map(str, CANCELLED))})"
_AFTER = (
    f"{g.TRADE_R}, {g.VALUES}, lost AS (SELECT dst AS id, coalesce(sum(amount) FILTER (WHERE type = 'SALE'), 0)::BIGINT AS b, coalesce(sum(amount) FILTER (WHERE type = 'PURCHASE'), 0)::BIGINT AS s FROM trade WHERE src IN {_GONE} GROUP BY dst), "
    f"after AS MATERIALIZED (SELECT v.id, CASE WHEN v.id IN {_GONE} THEN 0 ELSE sold - coalesce(s, 0) END AS sold, CASE WHEN v.id IN {_GONE} THEN 0 ELSE bought - coalesce(b, 0) END AS bought, CASE WHEN v.id IN {_GONE} THEN 0 ELSE desired END AS desired FROM vals v LEFT JOIN lost l ON l.id = v.id)"
)
_PROP = (
    f"{_AFTER}, links AS (SELECT t.src AS buyer, t.dst AS seller, min(t.edge_id) AS ord FROM trade t WHERE t.type = 'PURCHASE' GROUP BY 1, 2), "
    "cand AS (SELECT l.*, b.desired - b.bought AS need, s.bought - s.sold AS surplus FROM links l JOIN after b ON b.id = l.buyer AND b.desired > b.bought JOIN after s ON s.id = l.seller AND s.bought > s.sold), "
    "prop AS MATERIALIZED (SELECT buyer, seller, ord, amount FROM (SELECT *, greatest(0, least(surplus, need - coalesce(sum(surplus) OVER (PARTITION BY buyer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS amount FROM cand) WHERE amount > 0)"
)
_ADM = (
    f"{_PROP}, adm AS MATERIALIZED (SELECT buyer, seller, amount FROM (SELECT p.buyer, p.seller, greatest(0, least(p.amount, s.bought - s.sold - coalesce(sum(p.amount) OVER (PARTITION BY p.seller ORDER BY p.buyer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS amount FROM prop p JOIN after s ON s.id = p.seller) WHERE amount > 0)"
)
_STATE = (
    f"{_ADM}, state AS MATERIALIZED (SELECT a.id, (a.sold + coalesce((SELECT sum(amount) FROM adm WHERE seller = a.id), 0))::BIGINT AS sold, (a.bought + coalesce((SELECT sum(amount) FROM adm WHERE buyer = a.id), 0))::BIGINT AS bought, a.desired FROM after a)"
)


def _cancelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, trade = _trade(spark, sf)
    gone = spark.createDataFrame([(c,) for c in CANCELLED], "id long")
    return Scratch(spark).cut(qui.cancel_nodes(inf.node_values(nodes, trade), trade, gone)), trade


@query("cancelled_state", f"WITH {_AFTER} SELECT * FROM after")
def _(spark, sf):
    return _cancelled(spark, sf)[0]


@query("quiesce_proposals", f"WITH {_PROP} SELECT buyer, seller, amount FROM prop")
def _(spark, sf):
    return qui.propose(*_cancelled(spark, sf)).select("buyer", "seller", "amount")


@query("quiesce_admitted", f"WITH {_ADM} SELECT buyer, seller, amount FROM adm")
def _(spark, sf):
    values, trade = _cancelled(spark, sf)
    return qui.admit(values, qui.propose(values, trade))


@query("quiesced_state", f"WITH {_STATE} SELECT * FROM state")
def _(spark, sf):
    return qui.quiesce(*_cancelled(spark, sf), rounds=1)[0]


@query("state_violations", f"WITH {_STATE} SELECT id, 'sold' AS reason FROM state WHERE bought > 0 AND sold > bought + 0.01 UNION ALL SELECT id, 'bought' FROM state WHERE bought > desired + 0.01")
def _(spark, sf):
    return qui.state_violations(qui.quiesce(*_cancelled(spark, sf), rounds=1)[0])


@query("workflow_influencers", SQL["influencers_k3"])
def _(spark, sf):
    from skein.operators.trade.workflow import WorkflowConfig, run_workflow

    edges = g.infl_edges(spark, sf).withColumn("date", F.lit(None).cast("date"))
    return run_workflow(spark, (g.persons(edges), edges), WorkflowConfig(k=3, rrr=SETS, seed=SEED, topic=g.TOPIC))["influencers"]
