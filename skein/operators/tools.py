"""Data set tools: batching, counting, shuffling, packing of host loads, generators."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.draws import P, affine_permutation, draw
from skein.functions.ordered import numbered
from skein.operators.batches import assign_batches


def divide_into_batches(edges: DataFrame, batches: int, idx: str = "edge_idx", seed: int | None = None) -> DataFrame:
    """(batch, src, dst): ceil split of the input order, or of a seeded shuffle of it."""
    total = edges.count()
    if seed is not None:
        edges = shuffle_edges(edges, seed, idx)
    return assign_batches(edges, total, batches, idx=idx).select("batch", "src", "dst")


def shuffle_edges(edges: DataFrame, seed: int, idx: str = "edge_idx") -> DataFrame:
    """The same rows with `idx` permuted: a bijection, no row added or lost."""
    mixed = edges.withColumn("_d", draw(seed, F.col(idx), F.lit(17).cast("long")))
    return numbered(mixed.withColumnRenamed(idx, "_old"), ["_d", "_old"], idx).drop("_d", "_old")


def graph_counts(edges: DataFrame) -> DataFrame:
    """(max_vertex, edges)."""
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_vertex"), F.count(F.lit(1)).alias("edges"))


def count_batched(edges: DataFrame) -> DataFrame:
    """(vertices, edges) of a batched table: largest id plus one, and rows."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).cast("long").alias("vertices"), F.count(F.lit(1)).alias("edges"))


def first_batch_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("batch") == 0).agg(F.count(F.lit(1)).alias("edges"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def vhost_load(edges: DataFrame, vhosts: int) -> DataFrame:
    """(vhost, load): edges by source modulo the number of virtual hosts, empty ones too."""
    loads = edges.groupBy(F.pmod("src", F.lit(vhosts)).alias("vhost")).agg(F.count(F.lit(1)).alias("load"))
    return edges.sparkSession.range(vhosts).select(F.col("id").alias("vhost")).join(loads, "vhost", "left").select("vhost", F.coalesce("load", F.lit(0)).cast("long").alias("load"))


def pack_hosts(loads: DataFrame, hosts: int) -> DataFrame:
    """(host, load) ascending by load: largest virtual host first, always onto the least loaded host.

    The greedy is sequential over one row per virtual host, a parameter, not data.
    """
    rows = sorted((r["load"] for r in loads.select("load").collect()), reverse=True)
    heap = [(0, h) for h in range(hosts)]
    for load in rows:
        total, h = heapq.heappop(heap)
        heapq.heappush(heap, (total + load, h))
    return loads.sparkSession.createDataFrame([(h, t) for t, h in sorted(heap)], "host int, load long")


def kronecker_edges(spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1, permute: bool = True) -> DataFrame:
    """(edge_idx, src, dst): 2^scale vertices, edge_factor * 2^scale edges.

    Every bit of both ends is one quadrant draw in a column expression, so the generator is a
    plain projection of `spark.range` and runs in codegen at any size.
    """
    if not 0 < scale < 64:
        raise ValueError("scale must be in 1..63")
    n = 1 << scale
    cut_a, cut_b, cut_c = int(a * P), int((a + b) * P), int((a + b + c) * P)
    rows = spark.range(n * edge_factor).select(F.col("id").alias("edge_idx"))
    src = dst = F.lit(0).cast("long")
    for bit in range(scale):
        d = draw(seed, F.lit(bit).cast("long"), F.col("edge_idx"))
        rows = rows.withColumn(f"_q{bit}", F.when(d < cut_a, 0).when(d < cut_b, 1).when(d < cut_c, 2).otherwise(3))
        q = F.col(f"_q{bit}").cast("long")
        src = src + F.shiftright(q, 1) * F.lit(1 << bit)
        dst = dst + q.bitwiseAND(F.lit(1).cast("long")) * F.lit(1 << bit)
    if permute:
        src, dst = (affine_permutation(x, n, seed) for x in (src, dst))
    return rows.select("edge_idx", src.alias("src"), dst.alias("dst"))


def _unit(seed: int, a, b):
    return (draw(seed, a, b) + 1) / F.lit(P + 1.0)


def exponential_degrees(spark: SparkSession, n: int, mean: float = 20.0, seed: int = 7) -> DataFrame:
    """(id, degree): exponential with that mean; above 20 a tenth of it."""
    d = F.floor(-F.log(_unit(seed, F.lit(1).cast("long"), F.col("id"))) * mean)
    return spark.range(n).select("id", F.when(d > 20, F.floor(d / 10)).otherwise(d).cast("int").alias("degree"))


def generate_links(spark: SparkSession, sources: int, targets: int, seed: int = 7, self_loops: bool = True) -> DataFrame:
    """(src, dst): exponential out-degrees, uniform targets (social and uses files)."""
    rows = exponential_degrees(spark, sources, seed=seed).filter("degree > 0").select(F.col("id").alias("src"), F.explode(F.expr("sequence(1, degree)")).alias("k"))
    out = rows.select("src", F.pmod(draw(seed + 1, F.col("src"), F.col("k").cast("long")), F.lit(targets)).alias("dst"))
    return out if self_loops else out.filter(F.col("src") != F.col("dst"))


def generate_cyber(spark: SparkSession, servers: int, seed: int = 11, mean: float = 20.0, flows: DataFrame | None = None) -> DataFrame:
    """Eleven-column flows without self loops; exponential out-degrees with that mean, nothing cut.

    A target is drawn from the other servers, which is what drawing again until it differs from
    the source amounts to. With `flows`, a table of the nine attributes, each link takes those of
    a drawn row of it; otherwise they are drawn one by one.
    """
    degree = F.floor(-F.log(_unit(seed, F.lit(1).cast("long"), F.col("id"))) * mean + 0.5).cast("int")
    rows = spark.range(servers).select(F.col("id").alias("src"), degree.alias("d")).filter("d > 0").select("src", F.explode(F.expr("sequence(1L, cast(d as bigint))")).alias("k"))
    other = F.pmod(draw(seed + 1, F.col("src"), F.col("k")), F.lit(max(1, servers - 1)))
    base = rows.select("src", "k", F.when(other >= F.col("src"), other + 1).otherwise(other).alias("dst")) if servers > 1 else rows.select("src", "k", F.col("src").alias("dst")).limit(0)
    if flows is not None:
        names = ["epoch_time", "duration", "protocol", "src_port", "dst_port", "src_packets", "dst_packets", "src_bytes", "dst_bytes"]
        given = numbered(flows.select(*names), names, "_f")
        n = given.count()
        if not n:
            raise ValueError("the table of flows is empty")
        picked = base.withColumn("_f", F.pmod(draw(seed + 2, F.col("src"), F.col("k")), F.lit(n)))
        return picked.join(given, "_f").select("src", "dst", *names)
    num = lambda k, m: F.pmod(draw(seed + k + 2, F.col("src"), F.col("k")), F.lit(m)).alias
    names = ["duration", "protocol", "src_port", "dst_port", "src_packets", "dst_packets", "src_bytes", "dst_bytes"]
    sizes = [3600, 18, 65536, 65536, 1000, 1000, 100000, 100000]
    return base.select("src", "dst", num(1, 2592000)("epoch_time"), *[num(i + 2, m)(name) for i, (name, m) in enumerate(zip(names, sizes, strict=True))])


def generate_commercial(spark: SparkSession, persons: int, growers: int, distributors: int, wholesalers: int, customers: int, topic: int = 8486, seed: int = 13) -> DataFrame:
    """Sales down the hierarchy growers -> distributors -> wholesalers -> customers, and grower self-sales."""
    tiers, start, first = [growers, distributors, wholesalers, customers], 0, []
    for size in tiers:
        first.append(start)
        start += size
    if start > persons:
        raise ValueError("the tiers hold more persons than there are")
    out = None
    for t in range(3):
        buyers = spark.range(first[t + 1], first[t + 1] + tiers[t + 1]).select(F.col("id").alias("dst"), F.explode(F.expr("sequence(1, 3)")).cast("long").alias("k"))
        seller = F.pmod(draw(seed + t, F.col("dst"), F.col("k")), F.lit(tiers[t])) + first[t]
        amount = (F.pmod(draw(seed + 10 + t, F.col("dst"), F.col("k")), F.lit(1000)) + 1) / F.lit(10.0 ** (t + 1))
        part = buyers.select(seller.alias("src"), "dst", amount.alias("amount"))
        out = part if out is None else out.unionByName(part)
    own = spark.range(growers).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1000.0).alias("amount"))
    both = out.unionByName(own)
    return both.select(F.lit("Sale").alias("type"), "src", "dst", F.lit(topic).cast("long").alias("topic"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "amount")
