"""Chat formatting (operator 1): turns to one marked text per conversation, by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template, and all strings that texts may not hold unescaped.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]

_FIND = "([<\\[])(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"
_UNDO = re.compile(r"\\([\\_n])")
#: Rows and bytes that are assembled at once.
ROWS, BYTES = 8192, 1 << 22

SCHEMA = "conv_id long, part long, formatted string, n_turns long, loss_start array<long>, loss_end array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_string()), ("n_turns", pa.int64()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def escape(text: pa.Array) -> pa.Array:
    """Backslashes double and `\\_` breaks every control string after its first character."""
    text = pc.replace_substring(text, "\\", "\\\\")
    return pc.replace_substring_regex(text, _FIND, r"\1\\_\2")


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: {"\\": "\\", "_": "", "n": "\n"}[m[1]], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return pc.replace_substring(escape(pa.array([role])), "\n", "\\n")[0].as_py()


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def assemble(roles: pa.Array, texts: pa.Array, loss_role: str = "assistant") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, end of each turn, start and end of its content) of all turns in one buffer.

    A turn is three segments: header, content, footer. Their lengths give cumulative offsets,
    and one gather with scatter indices copies headers, contents and footers to their places.
    """
    roles = roles.fill_null("") if roles.null_count else roles
    texts = escape(texts.fill_null("") if texts.null_count else texts)
    coded = roles.dictionary_encode()
    heads = [(OPEN + escape_role(r) + "\n").encode() for r in coded.dictionary.to_pylist()]
    head_len = np.array([len(h) for h in heads] or [0])
    which = coded.indices.to_numpy(zero_copy_only=False)
    body, off = _bytes(texts)
    foot = CLOSE.encode()
    source = np.concatenate([body, np.frombuffer(b"".join(heads) + foot, np.uint8)])
    head_at = len(body) + np.concatenate([[0], np.cumsum(head_len)])
    lengths = np.stack([head_len[which], np.diff(off), np.full(len(which), len(foot))], 1).ravel()
    origin = np.stack([head_at[which], off[:-1], np.full(len(which), head_at[-1])], 1).ravel()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    np.take(source, np.arange(len(out)) + np.repeat(origin - starts, lengths), out=out)
    return out, ends[2::3], starts[1::3], ends[1::3]


def _parts(conv: np.ndarray, valid: np.ndarray, roles: pa.Array, texts: pa.Array, base: int, loss_role: str) -> pa.RecordBatch:
    """Consecutive turns, sorted by conversation, as one row per conversation."""
    out, turn_end, content, content_end = assemble(roles, texts)
    new = np.ones(len(conv), bool)
    new[1:] = (conv[1:] != conv[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(conv))
    begin = np.concatenate([[0], turn_end])[first]
    off = np.append(begin, len(out)).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off.tobytes()), pa.py_buffer(out))
    loss = pc.equal(roles, loss_role).fill_null(False).to_numpy(zero_copy_only=False)
    count = np.concatenate([[0], np.cumsum(loss)]).astype(np.int32)
    spans = np.concatenate([count[first], count[-1:]]).astype(np.int32)
    shift = np.repeat(begin, last - first)[loss]
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[loss] - shift)) for x in (content, content_end)]
    return pa.RecordBatch.from_arrays([pa.array(conv[first], pa.int64(), mask=~valid[first]), pa.array(base + np.arange(len(first))), text, pa.array((last - first).astype(np.int64)), *lists], schema=_ARROW)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, part, formatted, n_turns, loss_start, loss_end): the conversations as marked text.

    Turns are ordered by number, then role, then a hash of role and text; null numbers come
    first, rows that repeat are turns each. The rows are range-partitioned by that order, so a very long conversation spreads over tasks and comes
    as several parts, to be read in the order of `part`; others have one. Loss spans are byte
    offsets into `formatted` that cover the contents of `loss_role` turns. Null roles and texts
    count as empty, a null conv_id is a conversation of its own, an empty table gives none;
    other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x")).withColumn("h", F.xxhash64("r", "x"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "c", "t", "r", "h").sortWithinPartitions("c", "t", "r", "h", "x").select("c", "r", "x")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            lo = 0
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))])
            while lo < batch.num_rows:
                hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(size, size[lo] + BYTES, "right")) - 1), batch.num_rows)
                part = batch.slice(lo, hi - lo)
                c = part.column(0)
                out = _parts(pc.fill_null(c, 0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False), part.column(1), part.column(2), base, loss_role)
                base += out.num_rows
                lo = hi
                yield out.cast(pa.schema([f if f.name != "formatted" else pa.field("formatted", pa.string()) for f in _ARROW]))

    return rows.mapInArrow(run, SCHEMA)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(x)) for r, x in _TURN.findall(formatted)]


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, all read from the formatted parts and their loss spans.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The parts of a
    conversation stream through their digests in order; no conversation is held as a whole.
    """
    cols = ["conv_id", "part", "formatted", "loss_start", "loss_end"]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select(*cols).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        key, state, done = None, None, []

        def close():
            if state is not None:
                turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
                done.append((key[0], state["n"], turns, state["lc"], loss, state["fc"]))

        def flush():
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for conv, _, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv,):
                    close()
                    key, state = (conv,), {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "lc": 0, "fc": 0}
                raw = text.encode()
                for role, said in parse(text):
                    state["turns"].update(f"{role}\n{said}\n".encode())
                    state["n"] += 1
                for x, y in zip(a, b, strict=True):
                    said = unescape(raw[x:y].decode())
                    state["loss"].update(said.encode())
                    state["lc"] += len(said)
                state["fc"] += len(text)
            if len(done) > 4096:
                yield flush()
                done = []
        close()
        if done:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
