"""Best-fit packing of tokenized documents (operator 5).

Bulk-synchronous best-fit. Pieces are range-sorted by length and numbered within their length,
which is a distributed job. Pieces of one length are interchangeable, so the sweeps work on
runs: (length, how many) of the pieces and (gap, first sequence, how many) of the gaps. There are
at most `capacity` lengths, whatever the input, hence the sweeps' state is bounded by a
parameter. Each round hands every gap's successor at most one piece, settles conflicts by rank
(runs are matched from their lowest rank on), updates the gaps and repeats.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.runtime import Scratch

#: Bytes of words, ids and their bookkeeping that a worker keeps in each of two generations.
ROOM = 40 << 20
#: What one kept word costs beside its own bytes, and the longest word that is kept.
ENTRY, LONGEST = 170, 64
#: Words that the tokenizer gets at once.
CODED = 4096
#: Bytes of text that are cut into words at once.
BLOCK = 2 << 20
#: White space of the tokenizer's pattern beyond ASCII's; texts that hold it are not cut into words.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
_held: dict[str, object] = B.KEPT.setdefault(__name__, {})


class _Ids:
    """Word -> its ids as little-endian uint32 bytes.

    A word is blanks and what follows up to the next blank, cut once more where an ASCII letter
    meets ASCII punctuation. Byte-level BPE never merges over the ends of such words, so the ids
    of a text are those of its words. What is kept is bounded in bytes, whatever the words are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def hold(self, word: bytes, ids: bytes) -> None:
        """Keep a word; a full generation becomes the old one, whose words return when they are met again."""
        if len(word) > LONGEST:
            return
        if self.held > ROOM:
            self.old, self.now, self.held = self.now, {}, 0
        self.now[word] = ids
        self.held += len(word) + len(ids) + ENTRY

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        out = list(map(self.now.get, words))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = x = self.old.get(words[i])
            if x is None:
                new.append(i)
            else:
                self.hold(words[i], x)
        for lo in range(0, len(new), CODED):
            part = new[lo : lo + CODED]
            for i, x in zip(part, self.encode([words[i].decode() for i in part]), strict=True):
                out[i] = x
                self.hold(words[i], x)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the former leaves out offsets
        out = [array("I", e.ids) for e in batch(texts, add_special_tokens=False)]
        if sys.byteorder != "little":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]


def token_bytes(texts: pa.Array, path: str) -> Iterator[bytes]:
    """The ids of each whole text, as bytes; null counts as empty."""
    if path not in _held:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _held[path] = _Ids(path)
    ids: _Ids = _held[path]
    for lo, hi, b, off in B.blocks(texts, BLOCK):
        odd = {i for i, t in enumerate(texts.slice(lo, hi - lo).to_pylist()) if t and _ODD.search(t)}
        # a word begins with its text, where blanks follow something else, or where marks follow a letter
        blank = B.SPACE[b]
        begins = np.zeros(len(b) + 1, bool)
        begins[1:-1] = (blank[1:] & ~blank[:-1]) | (_LETTER[b[:-1]] & _MARK[b[1:]])
        begins[off] = True
        at = np.flatnonzero(begins[:-1]) if len(b) else np.zeros(0, np.int64)
        first = np.searchsorted(at, off)
        if odd:  # their words count for nothing
            keep = np.ones(len(at), bool)
            for i in odd:
                keep[first[i] : first[i + 1]] = False
        spans = pa.py_buffer(np.append(at, len(b)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, spans, pa.py_buffer(np.ascontiguousarray(b))])
        if odd:
            words = words.filter(pa.array(keep))
            first = np.append(0, np.cumsum(keep))[first]
        coded = words.dictionary_encode()
        each = ids.of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, start = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        end = np.append(0, np.cumsum(n))
        out = flat[np.arange(end[-1]) + np.repeat(start[code] - end[:-1], n)]
        for i, (x, y) in enumerate(zip(end[first[:-1]].tolist(), end[first[1:]].tolist(), strict=True)):
            yield ids.encode([texts[lo + i].as_py()])[0] if i in odd else out[x:y].tobytes()


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""

    def run(batches):
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1), path), strict=True):
                raw += int(end_id).to_bytes(4, "little")
                n = len(raw) // 4
                at, piece = 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    out.append((i, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, capacity
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(B.trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place all pieces.

    Lengths go from long to short. A round sends the pieces of the length at hand to the smallest
    gaps that hold them, one piece a gap, run by run in rank order; gaps shrink by the length and
    join the queue of their new size. Pieces that no gap holds open sequences.
    """
    queues: dict[int, deque] = {}
    sizes: list[int] = []  # gap sizes with a run, ascending
    placed, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in queues:
            queues[gap] = deque()
            insort(sizes, gap)
        queues[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor among the gaps
            if at == len(sizes):
                # no gap is large enough: as many sequences as these pieces fill on their own
                per = capacity // length
                full, rest = divmod(left, per)
                for j in range(per):
                    if full:
                        placed.append((length, rank + j * full, full, opened, j * length))
                if full:
                    add(capacity - per * length, opened, full)
                rank += per * full
                opened += full
                if rest:
                    for j in range(rest):
                        placed.append((length, rank + j, 1, opened, j * length))
                    add(capacity - rest * length, opened, 1)
                    opened += 1
                left = 0
                break
            gap = sizes[at]
            first, n = queues[gap].popleft()
            if not queues[gap]:
                del queues[gap]
                sizes.pop(at)
            take = min(n, left)
            placed.append((length, rank, take, first, capacity - gap))
            if take < n:
                if gap not in queues:
                    queues[gap] = deque()
                    insort(sizes, gap)
                queues[gap].appendleft((first + take, n - take))
            add(gap - length, first, take)
            rank, left = rank + take, left - take
    return placed


def best_fit(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """pieces (with `length` in 1..capacity) with sequence_id and offset, gapless from 0."""
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = scratch.cut(pieces)
    order = ["length", "doc_id", "piece", "ids_crc32"]

    def local_rank(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            new = np.ones(len(size), bool)
            new[1:] = size[1:] != size[:-1]
            first = np.flatnonzero(new)
            rank = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size)))) + held[size]
            np.add.at(held, size, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(rank)], names=[*batch.schema.names, "_part", "_rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    ranked = scratch.cut(base.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(B.trimmed(local_rank), f"{fields}, _part int, _rank long"))
    # partitions hold ranges of lengths: at most (partitions + capacity) rows
    tally = sorted((r["length"], r["_part"], r["n"]) for r in ranked.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, part, k in tally:
        before[(length, part)] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + k
    runs = sorted(sweep(counts, capacity))
    shared = spark.sparkContext.broadcast((np.array([r[0] << 40 | r[1] for r in runs], np.int64), np.array(runs, np.int64).reshape(-1, 5), before))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table, before = shared.value
        size = length.to_numpy()
        pos = rank.to_numpy() + np.array([before[x] for x in zip(size.tolist(), part.tolist(), strict=True)], np.int64)
        run = table[np.searchsorted(keys, size << 40 | pos, "right") - 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + pos - run[:, 1], "offset": run[:, 4]})

    return ranked.withColumn("_p", place("length", "_part", "_rank")).select(*base.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences.

    A document is the tokenizer's ids of its whole text and then end_id; null text counts as
    empty. Only documents longer than a sequence are cut: full pieces behind a first piece that
    may be shorter. Rows that repeat an id are packed each; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    return best_fit(cut_pieces(docs, tokenizer, capacity, id_col, text_col, end_id), capacity, scratch)
