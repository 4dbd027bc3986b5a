"""Word and shingle hashing of whole text columns in numpy.

A block is a run of rows whose texts together hold about BLOCK bytes (a longer text is a block
of its own), so memory follows the block and not the batch. Word hashes are polynomial hashes
read off one prefix sum per block; a shingle combines its words' hashes linearly and mixes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20


#: What modules keep in a worker from one task to the next: name of the module -> dict.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def forget(but: str = "") -> None:
    """Drop what modules other than `but` keep in this worker."""
    held = [x for name, x in KEPT.items() if x and name != but]
    for x in held:
        x.clear()
    if held:
        give_back()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which the worker gives freed memory back to the system.

    Workers serve one task after the other; what their allocators keep of a large one would
    count against the executor for as long as they live. So would what another module's tasks
    have kept for their like: that goes before `run` begins.
    """

    def whole(batches: Iterator) -> Iterator:
        forget(run.__module__)
        yield from run(batches)
        give_back()

    return whole


def free_name(base: str, *frames: DataFrame) -> str:
    """`base`, with underscores behind it until no column is called so (letter case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def first_by_hash(df: DataFrame, keys: list[str], rows: int, limit: int) -> DataFrame:
    """The `limit` rows of `rows` with the least hash of their keys: the same ones every time.

    Only rows below a hash that about 1.2 * limit + 100 rows undercut are sorted and sent on, so
    what reaches one place does not grow with the table.
    """
    h = F.xxhash64(*keys)
    if rows > 4 * (limit + 100):
        df = df.filter(h < F.lit(-(1 << 63) + int((1.2 * limit + 100) / rows * (1 << 64))))
    return df.orderBy(h, *keys).limit(limit)

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP2 = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_pow = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.cumprod(a, dtype=np.uint64)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows."""
    buf, off = text_buffer(texts)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word of a block, and the index of each row's first word (one more at the end)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACE[b]
    edge = np.zeros(len(b) + 1, bool)  # a row starts here
    edge[off] = True
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(b), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span; long blocks are done piece by piece."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + 4 * BLOCK, "right"))
        a, z = starts[i], ends[j - 1]
        up, down = _powers(int(z - a) + 1)
        sums = np.empty(z - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[b[a:z]] * up[: z - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def combine(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of k consecutive words at every position, as if all words were one row's."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    steps, m = (_STEP2 if second else _STEP), len(words) - k + 1
    out = words[:m] * steps[0]
    for j in range(1, k):
        out += words[j : j + m] * steps[j]
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of each row's first): all k-word shingles of each row.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(start[-1], np.uint64)
    full = combine(words, k)
    long = n >= k
    if long.any():
        take = np.repeat(long, count)
        pos = np.arange(start[-1]) - np.repeat(start[:-1], count) + np.repeat(first[:-1], count)
        out[take] = full[pos[take]]
    for r in np.flatnonzero((n > 0) & ~long):
        w = words[first[r] : first[r + 1]]
        out[start[r]] = mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, start


def sorted_sets(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of each row, and the new row starts."""
    if not len(hashes):
        return hashes, np.zeros(len(start), np.int64)
    row = np.repeat(np.arange(len(start) - 1, dtype=np.int64), np.diff(start))
    if len(start) <= 65536:  # a stable radix sort by row after one by hash
        order = np.argsort(hashes)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(start)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
