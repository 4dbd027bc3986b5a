import pytest
from pyspark.sql import functions as F

from skein.operators import GraphStore, betweenness, bfs_levels, pagerank, run_algorithm, triangle_count
from skein.operators.batches import assign_batches, batch_report, run_batches
from skein.operators.tools import kronecker_edges, pack_hosts, shuffle_edges, vhost_load

SMALL7 = {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2, 4, 5], 4: [3, 5], 5: [3, 4, 6], 6: [5]}
BIP5 = {0: [1, 2, 3], 1: [0, 4], 2: [0, 4], 3: [0, 4], 4: [1, 2, 3]}


def edges(spark, adj):
    return spark.createDataFrame([(s, d) for s, ds in adj.items() for d in ds], "src long, dst long")


def column(df, key, value):
    return [r[value] for r in df.orderBy(key).collect()]


def test_bfs(spark):
    assert column(bfs_levels(edges(spark, SMALL7), 7, 1), "vertex", "level") == [1, 0, 1, 1, 2, 2, 3]


def test_bfs_outside(spark):
    with pytest.warns(UserWarning):
        assert bfs_levels(edges(spark, SMALL7), 7, 9).count() == 0


@pytest.mark.parametrize(("adj", "n"), [(SMALL7, 5), ({0: [1, 2], 1: [0, 2], 2: [0, 1]}, 1), ({0: [1, 1, 2, 2], 1: [2]}, 2)])
def test_triangles(spark, adj, n):
    assert triangle_count(edges(spark, adj)).first()[0] == n


@pytest.mark.parametrize(("adj", "n", "want"), [({0: [1], 1: [2]}, 3, [0.05, 0.0925, 0.128625]), ({0: [5]}, 6, [0.025] * 5 + [0.04625])])
def test_pagerank_drops_mass(spark, adj, n, want):
    assert column(pagerank(edges(spark, adj), n), "vertex", "rank") == pytest.approx(want)


@pytest.mark.parametrize(("adj", "n", "want"), [({0: [1], 1: [0, 2], 2: [1, 3], 3: [2]}, 4, [0, 4, 4, 0]), (BIP5, 5, [3, 2 / 3, 2 / 3, 2 / 3, 3]), ({0: [1, 1, 2], 1: [3], 2: [3]}, 4, [0, 2 / 3, 1 / 3, 0])])
def test_betweenness(spark, adj, n, want):
    assert column(betweenness(edges(spark, adj), n), "vertex", "score") == pytest.approx(want)


@pytest.mark.parametrize("layout", ["adj", "csr", "lscsr"])
def test_layouts_agree(spark, layout):
    store = GraphStore(spark, layout, 0.5)
    for lo, hi in ((0, 3), (3, 7)):
        store.commit(edges(spark, {k: v for k, v in SMALL7.items() if lo <= k < hi}))
    assert (store.size(), store.edge_count(), run_algorithm("tc", store).first()[0]) == (7, 20, 5)
    assert column(store.csr(), "vertex", "row_end") == [3, 6, 9, 14, 16, 19, 20]
    with pytest.raises(ValueError):
        GraphStore(spark, "nonsense")


def test_batches(spark):
    e = spark.range(11).select(F.col("id").alias("edge_idx"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    sizes = {r["batch"]: r["edges"] for r in batch_report(assign_batches(e, 11, 3, 0.5)).collect()}
    assert sizes == {-1: 5, 0: 2, 1: 2, 2: 2}
    out = list(run_batches(GraphStore(spark), [edges(spark, {0: [1]}), None], "nop"))
    assert [len(m) for _, _, m in out] == [3, 1]


def test_tools(spark):
    e = kronecker_edges(spark, 5, 4)
    assert e.count() == 128 and e.filter("src < 0 or src > 31 or dst < 0 or dst > 31").count() == 0
    mixed = shuffle_edges(e, 3)
    assert column(mixed, "edge_idx", "edge_idx") == list(range(128))
    assert sum(r["load"] for r in pack_hosts(vhost_load(e, 8), 3).collect()) == 128


def test_degrees_and_edge_probes_cover_all_events(spark, tmp_path):
    from collections import Counter

    from skein.plans.queries import QUERIES

    users = [0, 40, 2, 40, 3, 3, 17, 40, 2, 17, 40, 2]
    rows = [(i, i, u) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "ts long, event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    edges = [(a, b) for a, b in zip(users, users[1:], strict=False) if a != b]
    degree = Counter(a for a, _ in edges)
    got = {r["vertex"]: r["degree"] for r in QUERIES["degree_zero_filled"](spark, str(tmp_path)).collect()}
    assert got == {v: degree[v] for v in range(41)}
    got = [tuple(r) for r in QUERIES["edge_exists"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(set(edges))


@pytest.mark.parametrize("groups", [1, 4])
def test_triangles_of_multigraphs_in_cells(spark, monkeypatch, groups):
    import random
    from collections import Counter
    from itertools import combinations

    from skein.operators import triangles

    monkeypatch.setattr(triangles, "_WALKS", 50)
    monkeypatch.setattr(triangles, "SMALL", 0 if groups > 1 else 1 << 14)
    monkeypatch.setattr(triangles, "GROUPS", groups)
    rng = random.Random(5)
    rows = [(rng.randrange(-3, 20), rng.randrange(-3, 20)) for _ in range(400)] + [(7, 30 + i % 9) for i in range(30)] + [(30 + i, 31 + i) for i in range(8)]
    m = Counter((a, b) for a, b in rows if a < b)
    ids = sorted({v for e in m for v in e})
    want = sum(m[a, b] * m[b, c] for a, b, c in combinations(ids, 3) if m[a, c])
    df = spark.createDataFrame([*rows, (None, 3), (3, None)], "src long, dst long")
    assert triangle_count(df).first()[0] == want
    assert triangle_count(df.limit(0)).first()[0] == 0


def test_walks_of_triangles_are_not_shuffled(spark):
    from pyspark import SparkContext

    # as for a table that is too large to broadcast
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    n = 260  # all pairs: 2.9 million walks
    ids = spark.range(n).select(F.col("id").alias("src"))
    df = ids.crossJoin(ids.withColumnRenamed("src", "dst"))
    store = spark._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, SparkContext._gateway.new_array(SparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    try:
        assert triangle_count(df).first()[0] == n * (n - 1) * (n - 2) // 6
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    assert written() - before < 15 * n * n
