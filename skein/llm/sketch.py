"""Count-min sketches over all rows of a table: built per task, merged slice by slice, broadcast.

A task turns its hashes into sorted slots with counts and emits them cut into slices; a slice's
parts are merged FAN at a time, level by level, by streaming passes that hold one slice's
counters, so what a task reads does not grow with the input. The merged sketch has a fixed size,
2^bits counters a row, so it may be collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.blocks import trimmed

SLICES = 64
#: Parts of a slice that one task merges.
FAN = 64
_FLUSH = 1 << 23


def slots(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The slot of each hash in one row of the sketch."""
    if row:
        hashes = hashes * np.uint64((0xD6E8FEB86659FD93 + 2 * row) & 0xFFFFFFFFFFFFFFFF)
        hashes = hashes ^ (hashes >> np.uint64(29))
        hashes = hashes * np.uint64(0xA0761D6478BD642F)
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def encode_gaps(sorted_values: np.ndarray) -> bytes:
    """Gaps between ascending values as bytes; 255 means 255 more."""
    if not len(sorted_values):
        return b""
    gaps = np.diff(sorted_values.astype(np.int64), prepend=0)
    more, last = gaps // 255, gaps % 255
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = last
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    return np.cumsum(a.astype(np.int64))[a != 255]


_PARTS = "slice int, part int, gaps binary, counts binary"
_EMIT = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])
_MERGED = pa.schema([("slice", pa.int32()), ("data", pa.binary())])


def _emit(found: list[np.ndarray], bits: int, row: int, part: int) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    width = 1 << bits - SLICES.bit_length() + 1
    cut = np.searchsorted(values, np.arange(SLICES + 1, dtype=np.int64) * width)
    rows = [(row * SLICES + i, part, encode_gaps(values[a:b] - i * width), np.minimum(counts[a:b], 255).astype(np.uint8).tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _EMIT.types, strict=True)], schema=_EMIT)


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int = 1, repeated: bool = False) -> np.ndarray:
    """The merged sketch of what `hashes` yields for every batch of df.

    repeated=False: an array (rows, 2^bits) of log2 of the counts, for ordering by rarity.
    repeated=True: packed bits (rows, 2^bits / 8), set where a slot counted two or more.
    Counts are never too low: a task's and a slot's saturate at 255 and 2^32.
    """
    width = 1 << bits - SLICES.bit_length() + 1

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: list[list[np.ndarray]] = [[] for _ in range(rows)]
        held = 0
        for batch in batches:
            for h in hashes(batch):
                for r in range(rows):
                    found[r].append(slots(h, bits, r))
                held += len(h) * rows
                if held > _FLUSH:
                    yield from (_emit(f, bits, r, part) for r, f in enumerate(found))
                    found, held = [[] for _ in range(rows)], 0
        if held:
            yield from (_emit(f, bits, r, part) for r, f in enumerate(found))

    def merged_slices(batches):
        """(slice, part, counters) of what a task reads, sorted by both."""
        now, acc = None, None
        for batch in batches:
            for s, p, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, p) != now:
                    if now is not None:
                        yield *now, acc
                    now, acc = (s, p), np.zeros(width, np.int64)
                acc[decode_gaps(gaps)] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield *now, acc

    def some(batches):
        for s, p, acc in merged_slices(batches):
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([s], [p], [encode_gaps(at)], [np.minimum(acc[at], 255).astype(np.uint8).tobytes()]), _EMIT.types, strict=True)], schema=_EMIT)

    def whole(batches):
        for s, _, acc in merged_slices(batches):
            data = np.packbits(acc >= 2) if repeated else np.ceil(np.log2(acc + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary())], schema=_MERGED)

    n = df.rdd.getNumPartitions()  # of the plan; nothing runs
    parts = df.mapInArrow(trimmed(count), _PARTS)
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}").cast("int")).repartition(SLICES * n, "slice", "part").sortWithinPartitions("slice", "part").mapInArrow(some, _PARTS)
    merged = parts.withColumn("part", F.lit(0)).repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(trimmed(whole), "slice int, data binary")
    size = width // 8 if repeated else width
    out = np.zeros((rows * SLICES, size), np.uint8)
    for row in merged.collect():  # rows * SLICES rows of a fixed size; an iterator would run a job per partition
        out[row["slice"]] = np.frombuffer(row["data"], np.uint8)
    return out.reshape(rows, -1)


def is_repeated(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's count may be two or more (never a false no)."""
    bits = (sketch.shape[1] * 8).bit_length() - 1
    out = np.ones(len(hashes), bool)
    for r in range(len(sketch)):
        s = slots(hashes, bits, r)
        out &= (sketch[r][s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
    return out


def log_counts(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log2 of each hash's (over)estimated count: the least over the rows."""
    bits = sketch.shape[1].bit_length() - 1
    out = sketch[0][slots(hashes, bits, 0)]
    for r in range(1, len(sketch)):
        out = np.minimum(out, sketch[r][slots(hashes, bits, r)])
    return out
