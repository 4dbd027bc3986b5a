"""Exact Jaccard joins of hashed token sets: rarity order, prefix, position and length filters,
and verification in prefix trees.

Records (documents or lines) are reduced to classes of equal sets first, so copies cost one row
each and are never paired. A token is its estimated log-frequency (8 bits) above 56 hash bits:
sorting tokens is the global order, rare ones first. Two sets with Jaccard >= num/den share a
token among the first n - ceil(n * num/den) + 1 of each, so only these are posted.

The sketch behind the order only steers cost: any fixed order gives the same pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm import sketch as S
from skein.runtime import Scratch

SKETCH_BITS = 24
#: Tokens with an estimated log2 frequency from here on skip the grouping that looks for partners.
HOT = 10
#: Parts of the tokens that are posted one after the other: shuffle files hold one part's postings.
POSTED = 3
#: Candidates that one tree holds.
TREE = 512
#: With no more wanted classes than this, their places (24 bytes each) are broadcast to the texts.
PLACES = 1 << 18
#: Mean tokens a record from which records are cut one by one.
LONG = 200
NO_ID = -(1 << 63)

#: Batch (doc, text) -> (row of the batch, line, hashes, first hash of each record); whole texts.
Records = Callable[[pa.RecordBatch], "Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]"]


@dataclass(frozen=True)
class Ratio:
    """A Jaccard threshold as a fraction, so that comparisons are exact."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def overlap(self, n: int, m: int) -> int:
        """The least intersection of sets of n and m tokens that link."""
        return -(-self.num * (n + m) // (self.num + self.den))


def tokens(hashes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return (S.log_counts(rarity, hashes).astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))


def class_ids(sets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each sorted distinct set (0 for an empty one)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(sets.copy()), dtype=np.uint64)])
    n = np.diff(start).astype(np.uint64)
    return np.where(n > 0, B.mix((sums[start[1:]] - sums[start[:-1]]) ^ (n * np.uint64(0x9E3779B97F4A7C15))), np.uint64(0))


def first_tokens(t: np.ndarray, start: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The `keep` least tokens of each record in ascending order, one after another."""
    rows = np.flatnonzero(keep)
    if not len(rows):
        return np.zeros(0, np.uint64)
    if len(t) > LONG * len(rows):
        return np.concatenate([np.sort(np.partition(t[start[i] : start[i + 1]], keep[i] - 1)[: keep[i]]) for i in rows])
    t, start = B.sorted_sets(t, start)
    at = np.concatenate([[0], np.cumsum(keep)])
    pos = np.arange(at[-1]) + np.repeat(start[:-1] - at[:-1], keep)
    return t[np.minimum(pos, len(t) - 1)]  # two hashes of a record may give one token


def marks(t: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Each set's length and the parity of its tokens in 64 * 2^j slots, the least such number that is no smaller.

    A token of one of two sets changes one parity, so two marks differ in no more slots than the
    sets in tokens. The hash's low bits give the slot: a larger mark folds into a smaller one.
    """
    n = np.diff(start)
    size = 8 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    slot = (t & np.repeat(size * 8 - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1] * 8, n)
    odd = np.packbits((np.bincount(slot, minlength=at[-1] * 8) & 1).astype(np.uint8)).tobytes()
    return [int(m).to_bytes(8, "little") + odd[i:j] for m, i, j in zip(n, at[:-1], at[1:], strict=True)]


def not_apart(probe: bytes, held: dict[int, bytes], ratio: Ratio) -> list[int]:
    """Which of the held marks do not rule out that their sets link with the probe's."""
    n, x = int.from_bytes(probe[:8], "little"), np.frombuffer(probe, np.uint8, offset=8)
    out = []
    for cid, raw in held.items():
        m, y = int.from_bytes(raw[:8], "little"), np.frombuffer(raw, np.uint8, offset=8)
        size = min(len(x), len(y))
        differ = np.bitwise_xor.reduce(np.concatenate([x, y]).reshape(-1, size))
        if int(np.bitwise_count(differ).sum()) <= n + m - 2 * ratio.overlap(n, m):
            out.append(cid)
    return out


_POSTED = pa.schema([("doc", pa.int64()), ("line", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("mark", pa.binary())])


class SetJoin:
    """One self-join of the records of `docs` (columns doc LONG, text STRING)."""

    def __init__(self, docs: DataFrame, records: Records, ratio: Ratio):
        self.docs, self.records, self.ratio = docs, records, ratio
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)

    def run(self) -> "SetJoin":
        """Fill `members` (doc, line, cid, n), `classes` (cid, n, doc, line of the first record, size), `marks` and `posted`.

        A posting is a class's prefix token with its position and the token's earliest posting
        (lead, ln, lp); postings of the lead itself are left out. The rows with all prefixes go
        once they are posted, and a part's shuffle files before the next part comes.
        """
        records, ratio, scratch = self.records, self.ratio, self.scratch
        cut = scratch.cut

        def hashes(batch):
            for _, _, h, _ in records(batch):
                yield h

        self.rarity = S.build(self.docs, hashes, SKETCH_BITS)
        shared = self.spark.sparkContext.broadcast(self.rarity)

        def post(batches):
            seen: set[int] = set()
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for row, line, h, start in records(batch):
                    sets, start = B.sorted_sets(h, start)
                    n = np.diff(start)
                    cid = B.signed(class_ids(sets, start))
                    t = tokens(sets, shared.value)
                    keep = np.minimum(ratio.prefix(n), n)
                    for i, c in enumerate(cid.tolist()):
                        if c in seen:
                            keep[i] = 0
                        elif n[i]:
                            seen.add(c)
                    flat = first_tokens(t, start, keep)
                    off = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                    prefix = pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))
                    mark = [m if k else None for m, k in zip(marks(t, start), keep, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(line.astype(np.int32)), pa.array(cid), pa.array(n.astype(np.int32)), prefix, pa.array(mark, pa.binary())], schema=_POSTED)

        rows = cut(self.docs.mapInArrow(B.trimmed(post), "doc long, line int, cid long, n int, prefix array<long>, mark binary"))
        scratch.release()  # the sketch's parts
        self.members = cut(rows.select("doc", "line", "cid", "n"))
        first = F.min(F.struct("doc", "line")).alias("f")
        self.classes = cut(self.members.filter("n > 0").groupBy("cid", "n").agg(first, F.count(F.lit(1)).alias("size")).select("cid", "n", "f.doc", "f.line", "size"))
        self.marks = cut(rows.filter("mark is not null").select("cid", "mark"))
        # a task posts a class once; its prefix comes from whichever record that was
        posts = rows.filter(F.size("prefix") > 0).select("cid", "n", "doc", "line", F.posexplode("prefix").alias("pos", "token"))
        hot = F.shiftrightunsigned("token", 56) >= HOT
        # a cold token has fewer than 2^HOT postings, so its window is small; hot ones aggregate partially
        lead = F.min(F.struct("doc", "line", "cid", "n", "pos"))
        in_token = W.partitionBy("token")

        def followers(posted):
            return cut(posted.filter("cid <> l.cid").select("token", "cid", "n", "pos", F.col("l.cid").alias("lead"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lp")))

        often = cut(posts.filter(hot))
        leads = cut(often.groupBy("token").agg(F.count(F.lit(1)).alias("c"), lead.alias("l")).filter("c > 1"))
        self._postings = [followers(often.join(leads.select("token", "l"), "token"))]
        for i in range(POSTED):
            scratch.release()
            part = posts.filter(~hot & (F.pmod("token", F.lit(POSTED)) == i))
            self._postings.append(followers(part.withColumn("c", F.count(F.lit(1)).over(in_token)).withColumn("l", lead.over(in_token)).filter("c > 1")))
        self.posted = reduce(DataFrame.unionByName, self._postings)
        scratch.drop(rows, often, leads)
        scratch.release()
        return self

    def _fits(self, nx, px, ny, py):
        """Length and position filters on two postings of one token."""
        num, den = self.ratio.num, self.ratio.den
        length = (F.least(nx, ny) * den >= F.greatest(nx, ny) * num)
        most = F.lit(1) + F.least(nx - px, ny - py) - 1
        return length & (most.cast("long") * (num + den) >= (nx + ny).cast("long") * num)

    def star_candidates(self) -> DataFrame:
        """(a, b): each posting's class with its token's earliest one; one row per posting at most."""
        near = self.posted.filter(self._fits(F.col("n"), F.col("pos"), F.col("ln"), F.col("lp")))
        return near.select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()

    def _met(self, pairs: DataFrame, held: DataFrame, test: Callable[[bytes, dict[int, bytes]], list[int]]) -> DataFrame:
        """The (a, b) of `pairs` that `test` lets pass; an a meets its b in groups of TREE or so.

        `held`: (cid, tokens). A class may come twice, with the same bytes: one of them is taken.
        """
        cut = self.scratch.cut
        trees = cut(pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {TREE}) as int)").alias("k")))
        right = pairs.join(trees, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
        right = right.join(held.select(F.col("cid").alias("b"), "tokens"), "b").select("a", "salt", "b", "tokens")
        left = trees.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt")).join(held.select(F.col("cid").alias("a"), "tokens"), "a")
        rows = left.select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens").unionByName(right)

        def walk(batches):
            key, probe, held = None, None, {}

            def done():
                hits = test(probe, held) if probe is not None and held else []
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], names=["a", "b"])

            for batch in batches:
                for a, s, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (a, s) != key:
                        yield from done()
                        key, probe, held = (a, s), None, {}
                    if b is None:
                        probe = t
                    else:
                        held[b] = t
            yield from done()

        found = cut(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(B.trimmed(walk), "a long, b long"))
        self.scratch.drop(trees)
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of `pairs` whose sets link, by prefix trees of at most TREE or so candidates.

        Sets are cut anew from the texts only for pairs that their marks do not keep apart: in a
        large table most candidates share a rare token by chance and no more than that.
        """
        ratio, records, scratch = self.ratio, self.records, self.scratch
        cut = scratch.cut
        pairs = cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        held = cut(self.marks.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("mark").alias("tokens")))
        near = self._met(pairs, held, lambda probe, held: not_apart(probe, held, ratio))
        scratch.drop(pairs, held)
        wanted = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        where = cut(self.classes.join(wanted, "cid", "left_semi").groupBy("doc").agg(F.collect_set("cid").alias("want")))
        few = (where.agg(F.sum(F.size("want"))).first()[0] or 0) <= PLACES
        shared = self.spark.sparkContext.broadcast(self.rarity)

        def sets_of(batches):
            for batch in batches:
                want = batch.column(2)
                for row, _, h, start in records(batch):
                    sets, start = B.sorted_sets(h, start)
                    cid = B.signed(class_ids(sets, start))
                    t = tokens(sets, shared.value)
                    ids, out, at = [], [], (-1, None)
                    for i in np.flatnonzero(np.diff(start)):
                        if at[0] != row[i]:
                            at = (row[i], set(want[int(row[i])].as_py()))
                        if (c := int(cid[i])) in at[1]:
                            ids.append(c)
                            out.append(np.sort(t[start[i] : start[i + 1]])[::-1].astype(">u8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["cid", "tokens"])

        # rows that repeat an id may yield a class twice
        sets = cut(self.docs.join(F.broadcast(where) if few else where, "doc").select("doc", "text", "want").mapInArrow(B.trimmed(sets_of), "cid long, tokens binary"))
        scratch.release()
        links = self._met(near, sets, lambda probe, held: linked(np.frombuffer(probe, ">u8"), held, ratio))
        scratch.drop(near, where, sets)
        scratch.release()
        return links

    def rest_candidates(self, known: DataFrame, tested: DataFrame, either: bool) -> DataFrame:
        """(a, b), a < b: what the stars left open, from the postings of tokens that hold an open class.

        `known`: (cid, grp). either=True: pairs of postings whose groups differ (a class without
        one is its own). Otherwise: the classes without a group, each with every other class of
        its tokens; which of two is the earlier one shows in `classes`, not in the postings.
        """
        cut = self.scratch.cut
        p = self.posted.select("token", "cid", "n", "pos").join(known, "cid", "left")
        if either:
            p = p.withColumn("grp", F.coalesce("grp", "cid"))
        p = cut(p)
        ends = (F.min("grp").alias("x"), F.max("grp").alias("y")) if either else (F.min("cid").alias("x"), F.max("cid").alias("y"))
        is_open = F.lit(True) if either else F.bool_or(F.col("grp").isNull())
        open_tokens = p.groupBy("token").agg(*ends, is_open.alias("o")).filter("o and x <> y").select("token")
        p = cut(p.join(cut(open_tokens), "token", "left_semi"))
        x, y = (p.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("cid", "n", "pos", "grp")]) for s in "xy")
        fits = self._fits(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"))
        once = F.col("y_grp").isNull() & (F.col("x_cid") != F.col("y_cid")) & (F.col("x_grp").isNotNull() | (F.col("x_cid") < F.col("y_cid")))
        apart = (F.col("x_grp") < F.col("y_grp")) if either else once

        def ordered(df, a, b):
            return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

        out = ordered(x.join(y, "token").filter(apart & fits), "x_cid", "y_cid").distinct()
        return out.join(ordered(tested, "a", "b"), ["a", "b"], "left_anti")


def linked(probe: np.ndarray, held: dict[int, bytes], ratio: Ratio) -> list[int]:
    """Which of the held sets link with the probe; all are in descending token order.

    The sets in lexicographic order with the lengths of their common prefixes are the paths of a
    prefix tree in depth-first order: `path[d]` is the overlap of the first d tokens, shared by
    all sets below that node. A path is left as soon as the tokens that remain on either side
    cannot reach the overlap that the length asks for.
    """
    asc = np.ascontiguousarray(probe[::-1]).astype(np.uint64)
    n, out = len(asc), []
    order = sorted(held.items(), key=lambda x: x[1])
    path = np.zeros(1, np.int64)
    was = np.zeros(0, np.uint64)
    for cid, raw in order:
        own = np.frombuffer(raw, ">u8").astype(np.uint64)
        m = len(own)
        need = ratio.overlap(n, m)
        depth = min(len(path) - 1, m)
        if depth:
            differ = np.flatnonzero(own[:depth] != was[:depth])
            depth = int(differ[0]) if len(differ) else depth
        path, ok = path[: depth + 1], min(n, m) >= need
        while ok:
            got = int(path[depth])
            if got + min(n - got, m - depth) < need:
                ok = False
            elif depth == m:
                break
            else:
                step = own[depth : depth + 64]
                at = np.searchsorted(asc, step)
                hit = (at < n) & (asc[np.minimum(at, n - 1)] == step)
                path = np.concatenate([path, got + np.cumsum(hit)])
                depth += len(step)
        was = own[:depth]
        if ok and path[depth] >= need:
            out.append(cid)
    return out


def brute_links(sets: list[set], ratio: Ratio) -> set[tuple[int, int]]:
    """All linked index pairs of a short list, for tests."""
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and ratio.den * len(sets[i] & sets[j]) >= ratio.num * len(sets[i] | sets[j])}


__all__ = ["HOT", "NO_ID", "Ratio", "SetJoin", "brute_links", "class_ids", "linked", "tokens"]
