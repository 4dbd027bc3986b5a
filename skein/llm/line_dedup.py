"""Near-duplicate line removal (operator 3): an exact set-similarity join of line token sets.

Lines with equal token sets form a class, so copies are never paired. A token is its estimated
log-frequency above 56 hash bits: sorted tokens begin with the rare ones, and two sets that reach
the Jaccard threshold share a token among the first n - ceil(n * num / den) + 1 of each. Tokens
that occur once in the whole table (the sketch never counts too low) are not posted at all.

Postings carry a bitmap of their set: sets of n and m tokens whose bitmaps differ in d bits share
at most (n + m - d) / 2 tokens. With the length and position filters this drops nearly all pairs
where they arise; the rest is verified on the sets. Where more pairs pass than a few for each
posting, a token holds many near copies: there each posting first meets the token's earliest
one, which settles nearly all, and only lines that are still open meet the others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm import sketch as S
from skein.llm.setjoin import NO_ID, Ratio, class_ids, tokens
from skein.runtime import Scratch

SKETCH_BITS = 24
#: Pairs for each posting of a token beyond which its postings are compared by way of the earliest.
DENSE = 16
#: Tokens with an estimated log2 frequency from here on are grouped by partial aggregates alone;
#: the groups of others fit a task and are compared in time.
HOT = 14
#: Parts of the tokens that are posted one after the other: shuffle files hold one part's postings.
POSTED = 3
#: Pairs of one line that a task verifies together.
CHUNK = 1024
#: With no more candidate lines than this, their places (24 bytes each) are broadcast to the texts.
PLACES = 1 << 18
#: Bytes of sets that are compared at once, and postings that are grouped at once.
COMPARED, GROUPED = 8 << 20, 1 << 17

_ROWS = "kind int, doc long, mark long, line int, cid long, n int, skip int, lo long, hi long, prefix array<long>"
_PAIRS = "kind int, a long, b long, at long, lo long, hi long"
_ROWS_ARROW = pa.schema(
    [("kind", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("skip", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("prefix", pa.list_(pa.int64()))]
)
_FIRST = ["doc", "mark", "line"]


def line_records(k: int):
    """Each line's tokens: its words, or its k-word shingles, A-Z in lower case."""

    def records(batch, column: int = 1):
        for lo, _, b, off in B.blocks(batch.column(column)):
            row, line, first, s, e = split_lines(b, off)
            words = B.word_hashes(B.LOWER[b], s, e)
            h, start = (words, first) if k == 1 else B.shingles(words, first, k)
            yield row + lo, line, h, start

    return records


def split_lines(b: np.ndarray, off: np.ndarray):
    """(row, line number) of each line, the index of each line's first word, and the word spans."""
    s, e, _ = B.word_spans(b, off)
    nl = np.flatnonzero(b == 10)
    owner = np.searchsorted(off, nl, "right") - 1
    row = np.concatenate([np.arange(len(off) - 1), owner])
    at = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    line = np.arange(len(row)) - np.searchsorted(row, np.arange(len(off) - 1))[row]
    return row, line, np.append(np.searchsorted(s, at), len(s)), s, e


def bitmaps(t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two words: one bit for each token."""
    lo, hi = np.zeros(len(start) - 1, np.uint64), np.zeros(len(start) - 1, np.uint64)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        bit = np.uint64(1) << ((t >> np.uint64(8)) & np.uint64(63))
        high = (t >> np.uint64(16)) & np.uint64(1) == 1
        lo[some] = np.bitwise_or.reduceat(np.where(high, np.uint64(0), bit), start[some])
        hi[some] = np.bitwise_or.reduceat(np.where(high, bit, np.uint64(0)), start[some])
    return lo, hi


def class_rows(records, ratio: Ratio, rarity):
    """The rows of a task: kind 0 for each line with tokens, its prefix and bitmap where the class is new; kind 1 for the earliest line of each class and its count."""

    def run(batches):
        seen: set[int] = set()
        members: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for row, line, h, start in records(batch):
                # one sort puts the tokens of a line in order of rarity and makes them distinct
                t, start = B.sorted_sets(tokens(h, rarity.value), start)
                n = np.diff(start)
                cid = B.signed(class_ids(t, start))
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n).tolist():
                    if (c := int(cid[i])) not in seen:
                        seen.add(c)
                        fresh[i] = True
                once = np.concatenate([[0], np.cumsum(t >> np.uint64(56) <= 1)])
                skip = once[start[1:]] - once[start[:-1]]
                keep = np.where(fresh, np.minimum(ratio.prefix(n), n), 0)
                size = np.maximum(keep - skip, 0)
                off = np.concatenate([[0], np.cumsum(size)])
                pos = np.arange(off[-1]) + np.repeat(start[:-1] + skip - off[:-1], size)
                lo, hi = bitmaps(t, start)
                some = np.flatnonzero(n)
                prefix = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(B.signed(t[pos])))
                doc, mark = ids[row], marks[row]
                columns = [pa.array(np.zeros(len(n), np.int32)), pa.array(doc), pa.array(mark), pa.array(line.astype(np.int32)), pa.array(cid), pa.array(n.astype(np.int32)), pa.array(skip.astype(np.int32)), pa.array(B.signed(lo)), pa.array(B.signed(hi)), prefix]
                members.append((cid[some], doc[some], mark[some], line[some].astype(np.int32)))
                if len(some):
                    yield pa.RecordBatch.from_arrays(columns, schema=_ROWS_ARROW).take(pa.array(some))
        if not members:
            return
        cid, doc, mark, line = (np.concatenate(x) for x in zip(*members, strict=True))
        order = np.lexsort((line, mark, doc, cid))
        cid, doc, mark, line = (x[order] for x in (cid, doc, mark, line))
        at = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])) if len(cid) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(cid))).astype(np.int32)
        for lo in range(0, len(at), 1 << 16):
            x = at[lo : lo + (1 << 16)]
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.array(doc[x]), pa.array(mark[x]), pa.array(line[x]), pa.array(cid[x]), pa.array(count[lo : lo + m]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], schema=_ROWS_ARROW
            )

    return run


def near_pairs(ratio: Ratio, dense: int | None):
    """The pairs of token groups that pass the filters (kind 0).

    With a limit, groups that hold more pairs than that for each posting give none: their
    postings are handed on (kind 1). Without one, only pairs count whose later posting is open,
    as the columns `open` and `doc` tell. Batches come sorted by token; a group that reaches over
    batches is carried on.
    """
    num, den = ratio.num, ratio.den
    names = ["kind", "a", "b", "at", "lo", "hi"]

    def pairs(group, most, at, lo, hi, *rest):
        """(indices of either side, groups with more pairs than `most`)."""
        n, pos = at >> 32, at & 0xFFFFFFFF
        found, count = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], np.zeros(len(most), np.int64)
        i, d = np.arange(len(group)), 0
        while True:
            d += 1
            i = i[i + d < len(group)]
            i = i[group[i] == group[i + d]]
            # sizes ascend within a group: the smaller set is done once the larger ones are out of its reach
            i = i[(n[i] - pos[i]) * (num + den) >= (n[i] + n[i + d]) * num]
            i = i[count[group[i]] <= most[group[i]]]
            if not len(i):
                break
            x, y = i, i + d
            if rest:
                is_open, doc = rest
                asked = ((is_open[x] > 0) & (doc[x] >= doc[y])) | ((is_open[y] > 0) & (doc[y] >= doc[x]))
                x, y = x[asked], y[asked]
            both = n[x] + n[y]
            ok = (n[y] - pos[y]) * (num + den) >= both * num
            x, y, both = x[ok], y[ok], both[ok]
            apart = np.bitwise_count((lo[x] ^ lo[y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((hi[x] ^ hi[y]).view(np.uint64))
            fits = (both - apart) // 2 * (num + den) >= both * num
            found.append((x[fits], y[fits]))
            np.add.at(count, group[x[fits]], 1)
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        over = count > most
        stay = ~over[group[x]]
        return x[stay], y[stay], over

    def done(parts):
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[2] >> 32, columns[0]))  # by token and size
        columns = [x[order] for x in columns]
        new = np.ones(len(order), bool)  # tasks may have posted one class each
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        columns = [x[new] for x in columns]
        token, cid = columns[:2]
        first = np.concatenate([[True], token[1:] != token[:-1]])
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        most = size * dense if dense is not None else np.full(len(size), np.iinfo(np.int64).max)
        x, y, over = pairs(group, most, *columns[2:])
        if len(x):
            a, b = cid[x], cid[y]
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], names=names)
        if over.any():
            rows = over[group]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(rows.sum()), np.int32)), *(pa.array(z[rows]) for z in columns[:5])], names=names)

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if sum(len(x[0]) for x in held) >= GROUPED and held[0][0][0] != held[-1][0][-1]:
                last = [np.searchsorted(x[0], held[-1][0][-1]) for x in held]  # the last group may go on
                yield from done([[c[:at] for c in x] for x, at in zip(held, last, strict=True)])
                held = [[c[at:] for c in x] for x, at in zip(held, last, strict=True) if at < len(x[0])]
        if held:
            yield from done(held)

    return run


def agree(ratio: Ratio):
    """The (a, b) whose sets x and y reach the ratio."""

    def hits(x: pa.Array, y: pa.Array) -> np.ndarray:
        rows, own, size = [], [], []
        for z in (x, y):
            ends = np.frombuffer(z.buffers()[1], np.int32)[z.offset : z.offset + len(z) + 1].astype(np.int64)
            own.append(np.frombuffer(z.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i8"))
            size.append(np.diff(ends) // 8)
            rows.append(np.repeat(np.arange(len(z)), size[-1]))
        row, own = np.concatenate(rows), np.concatenate(own)
        order = np.lexsort((own, row))
        row, own = row[order], own[order]
        # sets are distinct, so equal neighbours come from either side of one pair
        same = np.bincount(row[1:][(row[1:] == row[:-1]) & (own[1:] == own[:-1])], minlength=len(x))
        return same * ratio.den >= (size[0] + size[1] - same) * ratio.num

    def run(batches):
        for batch in batches:
            lengths = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (batch.column(2), batch.column(3)))
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED)))
                part = batch.slice(at, to - at)
                yield part.select([0, 1]).filter(pa.array(hits(part.column(2), part.column(3))))
                at = to

    return run


def _fits(ratio: Ratio, x: str, y: str) -> Column:
    """The length, position and bitmap filters on two postings of one token."""
    num, den = ratio.num, ratio.den
    n, m = (F.shiftright(f"{c}.at", 32) for c in (x, y))
    rest = F.least(*[F.shiftright(f"{c}.at", 32) - F.col(f"{c}.at").bitwiseAND(F.lit(0xFFFFFFFF)) for c in (x, y)])
    apart = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in ("lo", "hi")), F.lit(0))
    length = F.least(n, m) * den >= F.greatest(n, m) * num
    return length & (rest * (num + den) >= (n + m) * num) & (F.floor((n + m - apart) / 2) * (num + den) >= (n + m) * num)


def sets_of(own: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(cid, tokens): the hashed token sets of the wanted classes, cut anew from their first lines."""
    records = line_records(k)
    where = classes.join(wanted, "cid").select("cid", "f.doc", "f.mark", "f.line")
    where = scratch.cut(where.groupBy("doc", "mark").agg(F.collect_list(F.struct("line", "cid")).alias("want")))
    lines = where.agg(F.sum(F.size("want"))).first()[0] or 0

    def cut(batches):
        for batch in batches:
            want = [{x["line"]: x["cid"] for x in w} for w in batch.column(2).to_pylist()]
            for row, line, h, start in records(batch):
                ids, out = [], []
                pairs = zip(row.tolist(), line.tolist(), strict=True)
                for i, (r, n) in enumerate(pairs):
                    if n in want[r]:
                        ids.append(want[r][n])
                        out.append(np.unique(h[start[i] : start[i + 1]]).astype("<u8").tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["cid", "tokens"])

    found = own.join(F.broadcast(where) if lines <= PLACES else where, ["doc", "mark"]).select("doc", "text", "want").mapInArrow(B.trimmed(cut), "cid long, tokens binary")
    found = scratch.cut(found)
    if found.count() == lines:
        return found
    return scratch.cut(found.groupBy("cid").agg(F.first("tokens").alias("tokens")))  # rows repeat


def verified(pairs: DataFrame, sets: DataFrame, ratio: Ratio, scratch: Scratch) -> DataFrame:
    """The (a, b) of `pairs` whose sets reach the ratio; a line's pairs are dealt in chunks."""
    parts = scratch.cut(pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {CHUNK}) as int)").alias("k")))
    # sets are joined last: each join after them would shuffle them anew
    right = pairs.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    right = right.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    left = parts.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    both = right.select("a", "b", "salt", "y").join(left, ["a", "salt"]).select("a", "b", "x", "y")
    return both.mapInArrow(B.trimmed(agree(ratio)), "a long, b long")


def removed_lines(own: DataFrame, k: int, ratio: Ratio, scratch: Scratch) -> DataFrame:
    """(doc, mark, gone): for each document the numbers of the lines that an earlier line matches.

    `own` has (doc, text, mark). A pair is known as (a, b) with a earlier than b.
    """
    cut, records = scratch.cut, line_records(k)

    def hashes(batch):
        for _, _, h, _ in records(batch):
            yield h

    rarity = own.sparkSession.sparkContext.broadcast(S.build(own, hashes, SKETCH_BITS))
    rows = cut(own.mapInArrow(B.trimmed(class_rows(records, ratio, rarity)), _ROWS))
    # a class has one row of each task by now: partial aggregates would sort for nothing
    firsts = rows.filter("kind = 1").select("cid", *_FIRST, "n").repartition("cid")
    classes = cut(firsts.groupBy("cid").agg(F.min(F.struct(*_FIRST)).alias("f"), F.sum("n").alias("size")))

    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("p") + F.col("skip")).cast("long"))  # tokens of the set, position

    def posts(of: DataFrame) -> DataFrame:
        posted = of.select("cid", "n", "skip", "lo", "hi", F.posexplode("prefix").alias("p", "token"))
        return posted.select("token", "cid", at.alias("at"), "lo", "hi")

    new = rows.filter("kind = 0 and size(prefix) > 0")
    hot = F.shiftrightunsigned("token", 56) >= HOT
    grouped = []
    for i in range(POSTED):
        scratch.release()
        part = posts(new).filter(~hot & (F.pmod("token", F.lit(POSTED)) == i))
        grouped.append(cut(part.repartition("token").sortWithinPartitions("token").mapInArrow(B.trimmed(near_pairs(ratio, DENSE)), _PAIRS)))
    parts, grouped = grouped, reduce(DataFrame.unionByName, grouped)
    scratch.release()
    # prefixes ascend by frequency: the last token tells whether any is hot
    often = posts(new.filter(F.shiftrightunsigned(F.element_at("prefix", -1), 56) >= HOT)).filter(hot)
    often = often.groupBy("token", "cid").agg(*[F.first(c).alias(c) for c in ("at", "lo", "hi")])
    dealt = cut(grouped.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cid"), "at", "lo", "hi").unionByName(often))
    lines = cut(rows.filter("kind = 0").select("cid", *_FIRST))
    scratch.drop(rows)
    # all that follows asks for the classes of these postings and pairs alone
    asked = grouped.filter("kind = 0").select(F.explode(F.array("a", "b")).alias("cid")).unionByName(dealt.select("cid")).distinct()
    known = cut(classes.select("cid", "f").join(asked, "cid", "left_semi"))
    large = cut(dealt.join(known, "cid"))
    scratch.drop(dealt)
    lead = F.min(F.struct("f", "cid", "at", "lo", "hi")).alias("x")
    leads = cut(large.groupBy("token").agg(lead, F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    y = large.select("token", F.struct("f", "cid", "at", "lo", "hi").alias("y"))
    stars = y.join(leads, "token").filter((F.col("x.cid") != F.col("y.cid")) & _fits(ratio, "x", "y")).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))

    def ordered(pairs: DataFrame) -> DataFrame:
        a, b = (known.select(F.col("cid").alias(c), F.col("f").alias(f"f{c}")) for c in "ab")
        first = F.col("fa") < F.col("fb")
        return pairs.join(a, "a").join(b, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "shared")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()

    def settle(pairs: DataFrame, sets: DataFrame, settled: DataFrame | None) -> DataFrame:
        later = verified(pairs, sets, ratio, scratch).select(F.col("b").alias("cid")).distinct()
        return cut(later if settled is None else later.unionByName(settled).distinct())

    # a line is compared with the candidate that shares most rare tokens first, with others only if that fails
    near = grouped.filter("kind = 0").select("a", "b").unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tested = cut(ordered(near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))))
    scratch.drop(*parts)
    scratch.release()
    best = cut(tested.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select("m.a", "b"))
    sets = sets_of(own, known, ends(tested), k, scratch)
    settled = settle(best, sets, None)
    scratch.release()
    more = cut(tested.join(settled.select(F.col("cid").alias("b")), "b", "left_anti").join(best, ["a", "b"], "left_anti").select("a", "b"))
    if not more.isEmpty():
        settled = settle(more, sets, settled)
    # what the earliest postings left open in dense groups
    if not leads.isEmpty():
        is_open = F.when(F.col("hit").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("open")
        left = large.filter(~hot).join(settled.withColumn("hit", F.lit(True)), "cid", "left").select("token", "cid", "at", "lo", "hi", is_open, F.col("f.doc").alias("doc"))
        cold = left.repartition("token").sortWithinPartitions("token").mapInArrow(B.trimmed(near_pairs(ratio, None)), _PAIRS)
        x = large.filter(hot).join(settled, "cid", "left_anti").select("token", F.struct("f", "cid", "at", "lo", "hi").alias("x"))
        often = x.join(y.filter(hot), "token").filter((F.col("y.f") < F.col("x.f")) & _fits(ratio, "y", "x"))
        rest = cold.select("a", "b").unionByName(often.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))).distinct()
        rest = rest.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        rest = ordered(rest.withColumn("shared", F.lit(1))).join(settled.select(F.col("cid").alias("b")), "b", "left_anti")
        rest = cut(rest.select("a", "b"))
        if not rest.isEmpty():
            further = sets_of(own, known, ends(rest).join(sets, "cid", "left_anti"), k, scratch)
            settled = settle(rest, sets.unionByName(further), settled)

    scratch.drop(large, leads, tested, best, more, sets, known)
    scratch.release()
    # all lines of a settled class go, of other classes all but the first; a class may be in both parts
    first = [F.col(f"f.{c}").alias(f"f{c}") for c in _FIRST]
    copies = classes.filter("size > 1").select("cid", F.lit(False).alias("hit"), *first)
    out = cut(copies.unionByName(settled.withColumn("hit", F.lit(True)), allowMissingColumns=True))
    other = (F.col("doc") != F.col("fdoc")) | (F.col("mark") != F.col("fmark")) | (F.col("line") != F.col("fline"))
    gone = lines.join(out, "cid").filter(F.col("hit") | other)
    gone = cut(gone.groupBy("doc", "mark").agg(F.collect_set("line").alias("gone")))
    scratch.drop(lines, classes, settled, out)
    scratch.release()
    return gone


def kept_lines():
    """A column function: texts without the numbered lines; where none are numbered, the text is not passed."""

    @F.pandas_udf("text string, n_removed long")
    def keep(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out, n = [None] * len(text), np.zeros(len(text), np.int64)
        for i, (t, g) in enumerate(zip(text, gone, strict=True)):
            if t is not None and g is not None and len(g):
                drop = set(np.asarray(g).tolist())
                out[i], n[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop), len(drop)
        return pd.DataFrame({"text": out, "n_removed": n})

    return keep


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, lines_col: str = "_n_lines", removed_col: str = "_n_removed") -> DataFrame:
    """The rows of docs with later near-duplicate lines taken out, and _n_lines, _n_removed.

    Lines end at \\n. With k = 1 a line's tokens are its distinct words, else its distinct k-word
    shingles (its whole sequence, if it has fewer words); lines match at Jaccard >= num/den.
    Every line that matches an earlier line of the table, by (id, line number), goes, whether or
    not the earlier one stays. Blank lines match nothing; null and empty texts stay as they are.
    Rows that repeat an id and its text count as one document; rows that repeat an id with other
    texts are documents of their own, ordered by a hash of the text. A null id is smaller than
    all others. All columns are kept, an empty table gives none; the two new columns can be named.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    docs = docs.toDF(*[f"_{i}" for i in range(len(names))])  # names of the caller's must not clash with ours
    text, doc = f"_{names.index(text_col)}", F.coalesce(F.col(f"_{names.index(id_col)}").cast("long"), F.lit(NO_ID).cast("long")).alias("doc")
    mark = F.xxhash64(text).alias("mark")
    gone = removed_lines(docs.select(doc, F.col(text).alias("text"), mark), k, Ratio(num, den), scratch)
    out = docs.withColumns({"doc": doc, "mark": mark}).join(gone.hint("shuffle_hash"), ["doc", "mark"], "left")
    some = F.col("gone").isNotNull()
    out = out.withColumn("kept", kept_lines()(F.when(some, F.col(text)), F.col("gone")))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    kept = {text: F.when(some, F.col("kept.text")).otherwise(F.col(text))}
    cols = [kept.get(f"_{i}", F.col(f"_{i}")).alias(c) for i, c in enumerate(names)]
    return out.select(*cols, n_lines.cast("long").alias(lines_col), F.coalesce("kept.n_removed", F.lit(0)).cast("long").alias(removed_col))
