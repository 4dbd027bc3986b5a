"""Logs, reports, delimited files and generators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F


def lines(spark, files):
    rows = [(f, n, x) for f, text in files.items() for n, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, seq long, line string")


def test_bench_logs(spark):
    from skein.sources.logs import read_bench_logs

    section = "Benchmark results for {} for Batch {}:\nDuration: {} nanoseconds\nMax RSS: 77\nCache Misses: 1\nCache References: 2\nInstructions: 3\nMinor Page Faults: 4\nMajor Page Faults: 5"
    text = "Duration: 9 nanoseconds\n" + "\n".join(["noise", section.format("Ingestion", 0, 111), section.format("Post-ingest", 0, 222), section.format("Algorithm bfs", 0, 333), section.format("Ingestion", 1, 444)])
    out = read_bench_logs(spark, lines(spark, {"/x/d=road,a=bfs,g=csr,t=8.log": text})).collect()
    assert {(r["batch"], r["stage"]): r["duration_ns"] for r in out} == {(0, "ingest"): 111, (0, "post-ingest"): 222, (0, "algorithm"): 333, (1, "ingest"): 444}
    assert {(r["dataset"], r["algo"], r["graph"], r["threads"]) for r in out} == {("road", "bfs", "csr", 8)}
    assert all((r["max_rss"], r["cache_misses"], r["cache_references"], r["instructions"], r["minor_faults"], r["major_faults"]) == (77, 1, 2, 3, 4, 5) for r in out)


def host(n, rounds):
    out = ["started"]
    for r, (local, master, mirror, remote) in enumerate(rounds):
        out += [f"#####   Round {r}", f"local read (stream): {local}", f"master reads: {master}", f"master writes: {master + 1}", f"mirror reads: {mirror}", f"mirror writes: {mirror + 1}"]
        out += [f"remote communication for {p}: {v}" for p, v in enumerate(remote)]
    return "\n".join(out)


def test_traffic_logs_and_report(spark):
    from skein.sinks import traffic_stats
    from skein.sources.logs import read_traffic_logs, traffic_rounds

    files = {"/t/stats-0.log": host(0, [(5, 1, 0, [0, 7]), (6, 2, 3, [0, 0])]), "/t/stats-1.log": host(1, [(8, 0, 4, [9, 0]), (0, 0, 0, [2, 0])])}
    traffic = read_traffic_logs(spark, lines(spark, files))
    assert {(r["host"], r["peer"], r["round"]): r["n"] for r in traffic.filter("kind = 'remote' and n > 0").collect()} == {(0, 1, 0): 7, (1, 0, 0): 9, (1, 0, 1): 2}
    rolled = {r["round"]: (r["stream_read"], r["random_read"], r["random_write"], r["remote"]) for r in traffic_rounds(traffic).collect()}
    assert rolled == {0: (13, 5, 9, 16), 1: (6, 5, 9, 2)}
    report = {r["step"]: r["line"] for r in traffic_stats(traffic).collect()}
    assert sorted(report) == [0, 1, 2, 3]
    assert report[0] == "BSP 0\n# 0 0\nSTR RD 5 40\nRND RD 1 8\nRND WR 3 24\n# 1 1\nSTR RD 8 64\nRND RD 4 32\nRND WR 6 48"
    assert report[1] == "BSP 1\n# 0 1\nRND RMW 7 56\n# 1 0\nRND RMW 9 72"
    assert report[3] == "BSP 3\n# 1 0\nRND RMW 2 16"


def test_edge_list_takes_lines_of_two_fields(spark, tmp_path):
    from skein.sources.edges import read_edge_list

    (tmp_path / "e.txt").write_text("# head\n1 2\n1 2 9\n3\nx 4\n5 6\n\n7 8\n")
    out = read_edge_list(spark, str(tmp_path / "e.txt"))
    assert sorted((r["src"], r["dst"]) for r in out.collect()) == [(1, 2), (5, 6), (7, 8)]


def test_cyber_degrees_are_not_cut(spark):
    from skein.operators.tools import generate_cyber

    out = generate_cyber(spark, 3000).cache()
    degree = out.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d"), F.sum("d")).first()
    assert degree[0] > 100 and 17 < degree[1] / 3000 < 22
    assert out.filter("src = dst").count() == 0 and out.filter("dst < 0 or dst >= 3000").count() == 0
    flows = spark.createDataFrame([(i, 6, 80 + i, 90 + i, i, i + 1, i * 10, i * 20, i * 100) for i in range(5)], "duration long, protocol long, src_port long, dst_port long, src_packets long, dst_packets long, src_bytes long, dst_bytes long, epoch_time long")
    taken = generate_cyber(spark, 50, flows=flows)
    rows = {tuple(r) for r in flows.select("duration", "src_port", "dst_bytes").collect()}
    assert {tuple(r) for r in taken.select("duration", "src_port", "dst_bytes").distinct().collect()} == rows


def test_social_degrees(spark):
    from skein.operators.tools import exponential_degrees, generate_links

    d = exponential_degrees(spark, 4000).agg(F.max("degree"), F.avg("degree")).first()
    assert d[0] <= 20 or d[0] > 20 and d[1] < 20
    social = generate_links(spark, 300, 300, self_loops=False)
    assert social.filter("src = dst").count() == 0
    assert generate_links(spark, 300, 40).filter("dst >= 40 or dst < 0").count() == 0


def test_equal_parallel_sales_have_ids_of_their_own(spark):
    from skein.operators.trade.workflow import numbered_edges

    rows = [("SALE", "PERSON", 1, "PERSON", 2, 5.0, None)] * 3 + [("PURCHASE", "PERSON", 2, "PERSON", 1, 5.0, None)] * 3
    edges = spark.createDataFrame(rows, "type string, src_type string, src long, dst_type string, dst long, amount double, date string")
    assert sorted(r["edge_id"] for r in numbered_edges(edges).collect()) == list(range(6))


@pytest.mark.parametrize("k", [1, 4, 30])
def test_greedy_in_few_table_rewrites(spark, k):
    import random

    from skein.operators.trade.influence import greedy_influencers, uninfluenced_sets

    rng = random.Random(k)
    sets = {s: {rng.randint(0, 25) for _ in range(rng.randint(1, 6))} for s in range(120)}
    df = spark.createDataFrame([(s, v) for s, vs in sets.items() for v in vs], "set_id long, node long")
    picks, left = greedy_influencers(df, k, every=3)
    want, now = [], dict(sets)
    for i in range(k):
        count = Counter(v for vs in now.values() for v in vs)
        if not count:
            break
        node = min(count, key=lambda v: (-count[v], v))
        want.append((i, node, count[node]))
        if i < k - 1:
            now = {s: vs for s, vs in now.items() if node not in vs}
    assert [tuple(r) for r in picks.orderBy("pick").collect()] == want
    assert uninfluenced_sets(left).first()[0] == len(now)


def test_reverse_sets_stop_after_given_rounds(spark):
    from skein.operators.trade.influence import rrr_sets

    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    chain = spark.createDataFrame([(i, i + 1, i, 1, 1) for i in range(5)], "src long, dst long, edge_id long, amount long, total long")
    whole = {(r["set_id"], r["node"]) for r in rrr_sets(nodes, chain, 30, 5).collect()}
    roots = {s: min(v for t, v in whole if t == s) for s, _ in whole}
    assert whole == {(s, v) for s, r in roots.items() for v in range(r, 6)}
    early = {(r["set_id"], r["node"]) for r in rrr_sets(nodes, chain, 30, 5, max_rounds=2).collect()}
    assert early == {(s, v) for s, r in roots.items() for v in range(r, min(6, r + 3))}


def bc_reference(n, edges):
    """Betweenness by listing all shortest paths."""
    out = [0.0] * n
    for s in range(n):
        level, paths, frontier = {s: 0}, {s: [(s,)]}, [s]
        while frontier:
            new = {}
            for v in frontier:
                for a, b in edges:
                    if a == v and a != b and b not in level:
                        new.setdefault(b, []).extend(p + (b,) for p in paths[v])
            for v, ps in new.items():
                level[v], paths[v] = 1, ps
            frontier = list(new)
        for t, ps in paths.items():
            for p in ps:
                for v in p[1:-1]:
                    out[v] += 1 / len(ps)
    return out


@pytest.mark.parametrize("block", [1, 64])
def test_betweenness_by_listing_paths(spark, block):
    from skein.operators.betweenness import betweenness

    graphs = {
        "square": (4, [(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 3), (3, 1), (3, 2)], [1, 1, 1, 1]),
        "star": (4, [(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)], [6, 0, 0, 0]),
        "multi": (6, [(0, 1), (0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 4), (4, 0), (2, 5)], None),
    }
    for n, edges, want in graphs.values():
        got = [r["score"] for r in betweenness(spark.createDataFrame(edges, "src long, dst long"), n, block=block).orderBy("vertex").collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, bc_reference(n, edges), strict=True))
        assert want is None or got == want
