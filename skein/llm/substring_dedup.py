"""Removal of repeated passages (operator 8): windows of words that an earlier document has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm import sketch as S
from skein.llm.ngram_join import original_id, prepared
from skein.runtime import Scratch

#: Rows of the count-min sketch, and the least and the largest log2 of its width, which follows
#: the table's bytes: about eight counters an anchor. 2 x 2^29 counters are kept as 128 MB of bits.
SKETCH_ROWS, SKETCH_BITS = 2, (22, 29)
#: Windows that a task holds before it settles them among themselves: some 130 bytes each.
HELD = 1 << 21

_NAMES = ["h", "tail", "doc", "mark", "at", "starts"]


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Hashes of the grams that stand for windows, every window's anchor and the windows' starts.

    The anchor of a window is the least hash among its grams: equal windows have equal anchors,
    so a window occurs no more often than its anchor does.
    """
    n = np.diff(first)
    count = np.maximum(n - window + 1, 0)
    start = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(start[-1]) - np.repeat(start[:-1], count) + np.repeat(first[:-1], count)
    if not len(pos):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), pos
    g = B.combine(words, gram)
    w = window - gram + 1
    least = _sliding(g, w, np.minimum)
    valid = np.zeros(len(least), bool)
    valid[pos] = True
    # a gram is counted if it is the anchor of some window: the largest anchor among its windows equals it
    shown = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), shown, np.zeros(w - 1, np.uint64)])
    top = _sliding(padded, w, np.maximum)[: len(g)]
    return g[(top == g) & (g > 0)], least[pos], pos


def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One row for each of these windows, in its smallest document; the others are settled here. Empties the list."""
    h, tail, doc, mark, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((at, mark, doc, tail, h))
    h, tail, doc, mark, at = (x[order] for x in (h, tail, doc, mark, at))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (tail[1:] != tail[:-1])
    lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    settled = doc > lead
    # windows of the smallest document: one row a window and document, with all its starts there
    own = np.flatnonzero(~settled)
    if len(own):
        k = np.ones(len(own), bool)
        k[1:] = new[own][1:] | (mark[own][1:] != mark[own][:-1])
        begin = np.flatnonzero(k)
        n = np.diff(np.append(begin, len(own)))
        # by document: neighbours share id and mark, which compress; only further starts need a list
        by_doc = np.lexsort((at[own[begin]], mark[own[begin]], doc[own[begin]]))
        begin, n = begin[by_doc], n[by_doc]
        take = own[begin]
        for i in range(0, len(take), 1 << 16):
            x, more = take[i : i + (1 << 16)], n[i : i + (1 << 16)] - 1
            off = np.concatenate([[0], np.cumsum(more)])
            rest = np.repeat(begin[i : i + (1 << 16)] + 1 - off[:-1], more) + np.arange(off[-1])
            starts = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(at[own[rest]]), mask=pa.array(more == 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(tail[x]), pa.array(doc[x]), pa.array(mark[x]), pa.array(at[x]), starts], names=_NAMES)
    gone = np.flatnonzero(settled)
    if len(gone):
        gone = gone[np.lexsort((at[gone], mark[gone], doc[gone]))]
        k = np.ones(len(gone), bool)
        k[1:] = (doc[gone][1:] != doc[gone][:-1]) | (mark[gone][1:] != mark[gone][:-1])
        begin = np.flatnonzero(k)
        off = np.append(begin, len(gone)).astype(np.int32)
        starts = pa.ListArray.from_arrays(pa.array(off), pa.array(at[gone]))
        first = gone[begin]
        yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.nulls(len(first), pa.int64()), pa.array(doc[first]), pa.array(mark[first]), pa.nulls(len(first), pa.int32()), starts], names=_NAMES)


def suspects(batches: Iterator[pa.RecordBatch], sketch: Callable[[], np.ndarray], window: int, gram: int, held: int) -> Iterator[pa.RecordBatch]:
    """The suspected windows of (doc, text, mark), settled among about `held` of them at a time."""
    parts: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        marks = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, b, off in B.blocks(batch.column(1)):
            s, e, first = B.word_spans(b, off)
            words = B.word_hashes(b, s, e)
            _, anchor, pos = anchors(words, first, window, gram)
            pos = pos[S.is_repeated(sketch(), anchor)]
            if len(pos):
                row = np.searchsorted(first, pos, "right") - 1
                h, h2 = B.combine(words, window)[pos], B.combine(words, window, True)[pos]
                parts.append((B.signed(h), (h2 >> np.uint64(33)).astype(np.int64), ids[lo:hi][row], marks[lo:hi][row], (pos - first[row]).astype(np.int32)))
                n += len(pos)
            if n >= held:
                yield from settle(parts)
                n = 0
    if parts:
        yield from settle(parts)


def removed_windows(docs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(doc, mark, starts): windows of a document that also start in a document with a smaller id.

    `docs` has (doc, text, mark): mark, a hash of the text, tells rows that repeat an id apart.
    """

    def counted(batch):
        for _, _, b, off in B.blocks(batch.column(1)):
            s, e, first = B.word_spans(b, off)
            yield anchors(B.word_hashes(b, s, e), first, window, gram)[0]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchored = size // 6 * 2 // (window - gram + 2)  # words, and the share of grams that are least in some window
    merged = S.build(docs, counted, min(max((8 * anchored).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1]), SKETCH_ROWS, repeated=True)
    shared = docs.sparkSession.sparkContext.broadcast(merged)
    held = HELD
    run = B.trimmed(lambda batches: suspects(batches, lambda: shared.value, window, gram, held))
    rows = docs.mapInArrow(run, "h long, tail long, doc long, mark long, at int, starts array<int>")
    # shuffled as few bytes: tail (31 bits) and first start as one word
    rows = rows.select("h", F.shiftleft("tail", 32).bitwiseOR(F.col("at").cast("long")).alias("place"), "doc", "mark", "starts")
    tail, at = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    # place is null in rows that a task has settled; they only travel along
    least = F.min("doc").over(W.partitionBy("h", tail))
    found = rows.withColumn("_least", least).filter(F.col("place").isNull() | (F.col("doc") > F.col("_least")))
    starts = F.when(F.col("place").isNull(), F.col("starts")).otherwise(F.concat(F.array(at), F.coalesce("starts", F.array().cast("array<int>"))))
    return scratch.cut(found.select("doc", "mark", starts.alias("starts")).groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6) -> DataFrame:
    """(doc_id, text, n_words, n_removed): texts without the words of repeated windows.

    A window is `window` consecutive words (runs without ASCII white space) of one document. All
    words of a window go whose word sequence also starts in a document with a smaller id; windows
    are judged on the input. Kept words are joined by one space. Null text has no words and gives
    an empty text; ids are taken as they are, a null id being the smallest; rows that repeat an
    id, with one text or several, never remove from each other; other columns are ignored; an
    empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    own = prepared(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    gone = removed_windows(own, window, gram, scratch)
    scratch.release()  # before the texts are shuffled: the windows' shuffle is the largest

    @F.pandas_udf("text string, n_words long, n_removed long")
    def keep(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        kept, total, removed = [], [], []
        for t, s in zip(text, starts, strict=True):
            words = t.encode().split() if t else []
            if s is not None and len(s):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, np.asarray(s) + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                total.append(len(words))
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                removed.append(total[-1] - len(words))
            else:
                total.append(len(words))
                removed.append(0)
            kept.append(b" ".join(words).decode())
        return pd.DataFrame({"text": kept, "n_words": total, "n_removed": removed})

    out = own.join(gone, ["doc", "mark"], "left").withColumn("k", keep("text", "starts"))
    return out.select(original_id("doc", "doc_id"), "k.text", "k.n_words", "k.n_removed")


