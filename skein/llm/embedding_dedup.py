"""Near-duplicate embeddings (operator 4): an inverted multi-index of two codebooks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.blocks import first_by_hash
from skein.llm.components import components
from skein.runtime import Scratch

#: Vectors that the codebooks are fitted on, by hash order; the first QUERIES of them are compared
#: with the whole table for the number of visited cells.
SAMPLE, QUERIES = 8192, 1024
#: Least and most codewords of either half: their number grows with the vectors, about CELL of one
#: label to a cell of the grid.
WORDS, CELL = (32, 128), 64
#: Rows of either side that one comparison holds, and vectors whose cells are ranked at once.
BLOCK, RANKED = 1024, 64
TARGET = 0.995
#: With fewer near pairs than this, the greatest rank counts, and SPARSE visits at least.
FEW, SPARSE = 200, 16


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves of unit vectors; a vector visits its nearest `visits` cells."""

    left: np.ndarray
    right: np.ndarray
    visits: int


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def nearest_cells(unit: np.ndarray, left: np.ndarray, right: np.ndarray, visits: int) -> np.ndarray:
    """The `visits` nearest cells of each vector, the nearest first.

    The batch form of multi-sequence traversal: with both halves' codewords sorted by distance, a
    cell of ranks (i, j) comes after (i+1)(j+1)-1 others, so only rank pairs whose product is at
    most `visits` can be among them.
    """
    half = unit.shape[1] // 2
    d1, d2 = _distances(unit[:, :half], left), _distances(unit[:, half:], right)
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    pairs = [(i, j) for i in range(len(left)) for j in range(len(right)) if (i + 1) * (j + 1) <= visits]
    i, j = np.array(pairs).T
    best = np.argsort(d1[:, i] + d2[:, j], 1, kind="stable")[:, :visits]
    return (np.take_along_axis(o1, i[best], 1) * len(right) + np.take_along_axis(o2, j[best], 1)).astype(np.int32)


def cell_ranks(unit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of every cell by its distance, for each vector."""
    every = len(left) * len(right)
    ranks = np.empty((len(unit), every), np.int16)
    for lo in range(0, len(unit), RANKED):
        order = nearest_cells(unit[lo : lo + RANKED], left, right, every)
        np.put_along_axis(ranks[lo : lo + RANKED], order, np.arange(every, dtype=np.int16)[None], 1)
    return ranks


def codewords(classes: int, labels: int) -> int:
    """Codewords of either half for a table of so many classes and labels."""
    return min(max(int((classes / max(1, labels) / CELL) ** 0.5), WORDS[0]), WORDS[1])


def visits(counts: dict[int, int], every: int, target: float = TARGET) -> int:
    """The visits after which `target` of the near pairs are found; counts: pairs by rank."""
    total = sum(counts.values())
    if total < FEW:
        return min(every, max(SPARSE, max(counts, default=0) + 2))
    seen = 0
    for rank in sorted(counts):
        seen += counts[rank]
        if seen >= target * total:
            break
    return min(every, max(8, rank + 2))


def fit(classes: DataFrame, cids: np.ndarray, unit: np.ndarray, label: list[str], threshold: float, words: int = WORDS[0]) -> Index:
    """Codebooks from the sample, and visits from the first QUERIES of it against all `classes` of their length."""
    half = unit.shape[1] // 2
    left, right = _kmeans(unit[:, :half], words, 1), _kmeans(unit[:, half:], words, 2)
    every = len(left) * len(right)
    names = {x: i for i, x in enumerate(dict.fromkeys(label[:QUERIES]))}
    kind = np.array([names[x] for x in label[:QUERIES]])
    ranks = cell_ranks(unit[:QUERIES], left, right)
    asked = classes.sparkSession.sparkContext.broadcast((cids[:QUERIES], unit[:QUERIES], kind, names, ranks, ranks.argmin(1), left, right))

    def pairs(batches):
        cid, q, kind, names, ranks, home, left, right = asked.value
        total = np.zeros(every, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                own = part.column(0).to_numpy(zero_copy_only=False)
                of = np.array([names.get(x, -1) for x in part.column(1).to_pylist()])
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                x = x / np.sqrt((x * x).sum(1))[:, None]
                a, b = np.nonzero((q @ x.T >= threshold) & (kind[:, None] == of[None]) & (cid[:, None] != own[None]))
                if len(a):
                    hit, b = np.unique(b, return_inverse=True)
                    back = cell_ranks(x[hit], left, right)
                    total += np.bincount(np.minimum(ranks[a, back.argmin(1)[b]], back[b, home[a]]), minlength=every)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["rank", "n"])

    found = classes.select("cid", "label", "v").mapInArrow(pairs, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()  # a row per cell at most
    return Index(left, right, visits({r["rank"]: r["n"] for r in found}, every))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of equal label linked by cosine >= threshold.

    Equal vectors of a label form one class that is indexed once and counts with its size. Every
    class lies in its nearest cell and visits further cells; a pair is verified in double
    precision where either visits the other's cell, and counted once. Crowded cells are compared
    block by block. Vectors link with those of their length; every length has its own codebooks,
    one of at most `sample` classes is a single cell instead, unless it is the most frequent.
    Vectors that are null, zero, or hold null or non-finite components, and those without a
    label, link with nothing. Components are scaled by a power of two, which is exact, so that
    squares of very large or small ones neither overflow nor vanish. Repeated ids are rows of
    their own; other columns are ignored; an empty table gives none.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("dim", F.when(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), F.size("v")))
    # two halves of the power: a whole one may lie beyond the doubles
    power = F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x)))))
    half = F.floor(power / 2)
    scaled = F.transform("v", lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power))
    rows = rows.withColumn("v", F.when(F.col("dim").isNotNull(), scaled))
    # -0.0 and 0.0 are one value; two vectors that differ in that alone have cosine 1 as well
    rows = scratch.cut(rows.withColumn("cid", F.when(F.col("dim").isNotNull(), F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0))))))
    # the length is part of the label from here on
    keyed = rows.filter("cid is not null").withColumn("label", F.concat_ws(":", F.col("dim").cast("string"), "label"))
    classes = keyed.groupBy("cid", "dim", "label").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = scratch.cut(classes)
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows"), F.count_distinct("label").alias("labels"))
    sizes = scratch.cut(sizes)
    usual = sizes.orderBy(F.desc("rows"), F.desc("dim")).limit(1).collect()  # one row
    if not usual:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fitted = {r["dim"]: r for r in [*usual, *sizes.filter(F.col("n") > sample).collect()]}  # lengths of many classes
    index = {}
    for dim, r in fitted.items():
        of_dim = classes.filter(F.col("dim") == dim)
        some = first_by_hash(of_dim, ["cid"], r["n"], sample).select("cid", "label", "v").collect()  # `sample` rows
        x = np.array([r["v"] for r in some])
        index[dim] = fit(of_dim, np.array([r["cid"] for r in some]), x / np.sqrt((x * x).sum(1))[:, None], [r["label"] for r in some], threshold, codewords(r["n"], r["labels"]))
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            vec = batch.column(3)
            size = vec.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                flat = np.ascontiguousarray(part.column(3).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(part.num_rows, -1)
                ix = shared.value.get(int(dim))
                cells = np.zeros((len(flat), 1), np.int32)
                if ix:
                    cells = nearest_cells(flat / np.sqrt((flat * flat).sum(1))[:, None], ix.left, ix.right, ix.visits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in flat]), lists], names=["cid", "label", "m", "raw", "cells"])

    placed = scratch.cut(classes.select("cid", "label", "m", "v").mapInArrow(assign, "cid long, label string, m long, raw binary, cells array<int>"))
    own = placed.withColumn("cell", F.col("cells")[0])
    crowd = scratch.cut(own.groupBy("label", "cell").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("k")))
    block = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    held = own.join(crowd, ["label", "cell"]).select("label", "cell", block.alias("blk"), F.lit(0).alias("kind"), "cid", "m", "raw", "cells", "k")
    asks = placed.select("cid", "label", "m", "raw", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell")).join(crowd, ["label", "cell"])
    # a probe goes to every block of the cell; the probes of a cell are cut into blocks as well
    asks = asks.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("blk"), F.lit(1).alias("kind"), "cid", "m", "raw", F.array("home").alias("cells"), "k")
    n_probe = scratch.cut(asks.groupBy("label", "cell", "blk").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("j")))
    key = ["label", "cell", "blk"]
    asks = asks.join(n_probe, key).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("j")).cast("int"))
    held = held.join(n_probe, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
    cols = ["label", "cell", "blk", "part", "kind", "cid", "m", "raw", "cells"]
    both = held.select(*cols).unionByName(asks.select(*cols))

    def compare(batches):
        key, got = None, ([], [])
        names = ["cid", "add", "root"]
        done: list[tuple[np.ndarray, ...]] = []

        def close():
            index, probe = got
            if not index or not probe:
                return
            yc, ym, yr, ycells = zip(*index, strict=True)
            xc, xm, xr, home = zip(*probe, strict=True)
            yc, ym, xc, xm = (np.array(z, np.int64) for z in (yc, ym, xc, xm))
            near = _unit(list(xr)) @ _unit(list(yr)).T >= threshold
            near &= xc[:, None] != yc[None]
            if not near.any():
                return
            mutual = _member(home, ycells)
            count = near & (~mutual | (xc[:, None] < yc[None]))
            low_x, low_y = xc.copy(), yc.copy()
            while True:
                nx = np.minimum(low_x, np.where(near, low_y[None], np.iinfo(np.int64).max).min(1))
                ny = np.minimum(low_y, np.where(near, nx[:, None], np.iinfo(np.int64).max).min(0))
                if (nx == low_x).all() and (ny == low_y).all():
                    break
                low_x, low_y = nx, ny
            for ids, add, low in ((xc, count @ ym, low_x), (yc, xm @ count, low_y)):
                hit = (add > 0) | (low != ids)
                done.append((ids[hit], add[hit], low[hit]))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*done, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    close()
                    key, got = row[:4], ([], [])
                    if sum(len(d[0]) for d in done[-64:]) > 20000 or len(done) > 20000:
                        yield flush()
                        done = []
                got[row[4]].append(row[5:])
        close()
        if done:
            yield flush()

    found = scratch.cut(both.repartition("label", "cell", "blk", "part").sortWithinPartitions("label", "cell", "blk", "part", "kind").mapInArrow(compare, "cid long, add long, root long"))
    links = scratch.cut(found.groupBy("cid").agg(F.sum("add").alias("links")))
    roots = components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    named = scratch.cut(classes.select("cid", "m", "first").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "m", "first", "links", F.coalesce("root", "cid").alias("root")))
    label = scratch.cut(named.groupBy("root").agg(F.min("first").alias("component")))
    final = scratch.cut(named.join(label, "root").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component"))
    out = rows.select("vec_id", "cid").join(final, "cid", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _member(home, cells) -> np.ndarray:
    """Whether each probe's own cell is among each vector's visited cells."""
    h = np.array([x[0] for x in home])
    table = np.array(cells)
    out = np.zeros((len(h), len(table)), bool)
    for j in range(table.shape[1]):
        out |= h[:, None] == table[None, :, j]
    return out


def brute_force(x: np.ndarray, labels: list, threshold: float) -> np.ndarray:
    """The link matrix of a small table, for recall."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    same = np.array(labels)[:, None] == np.array(labels)[None]
    return (unit @ unit.T >= threshold) & same & ~np.eye(len(x), dtype=bool)
