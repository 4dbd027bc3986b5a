import random

import numpy as np
import pytest

from tests.llm.test_operators import LOWER, WORD


def words(line):
    return set(WORD.findall(line.translate(LOWER)))


def brute(rows):
    """(id, text) -> kept text, by comparing every line with all earlier ones as sets of words."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            s = words(line)
            if not any(s and t and 5 * len(s & t) >= 4 * len(s | t) for t in seen):
                kept.append(line)
            seen.append(s)
        out[doc] = ("\n".join(kept), text.count("\n") + 1 - len(kept))
    return out


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(150)]
    for line in lines[:90]:  # one or more words changed, order changed, letters in upper case
        w = line.split()
        for i in rng.sample(range(len(w)), min(len(w), rng.randint(1, 8))):
            w[i] = rng.choice(vocab)
        rng.shuffle(w)
        lines.append(" ".join(w).upper() if len(w) % 2 else " ".join(w))
    lines += ["", " \t", *["the line that every source repeats, word for word"] * 30]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]
    long = " ".join(rng.choices(vocab, k=30000)) + "\n" + " ".join(f"x{i}" for i in range(3000))
    return [*rows, (900, long), (901, long.replace("x7 ", "y7 "))]


@pytest.mark.parametrize("dense", [16, 0])
def test_word_lines_against_brute_force(spark, monkeypatch, dense):
    from skein.llm import line_dedup as ld

    monkeypatch.setattr(ld, "DENSE", dense)
    rows = corpus()
    want = brute(rows)
    random.Random(dense).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ld.dedup_lines(docs, k=1).collect()}
    assert {i: (r["text"], r["_n_removed"]) for i, r in got.items()} == want
    assert all(got[i]["_n_lines"] == t.count("\n") + 1 for i, t in rows)


def test_a_changed_word_in_a_line_of_forty(spark):
    from skein.llm.line_dedup import dedup_lines

    w = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:20], "other", *w[21:]])), (3, " ".join([*w[:20], *(f"b{i}" for i in range(20))]))]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert out == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_a_group_of_near_copies_and_hot_tokens(spark, monkeypatch):
    from skein.llm import line_dedup as ld

    monkeypatch.setattr(ld, "DENSE", 2)
    monkeypatch.setattr(ld, "HOT", 3)
    base = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"u{i}", f"v{i}"])) for i in range(300)] + [(300 + i, " ".join([*base[: i % 30], *(f"z{i}w{j}" for j in range(9))])) for i in range(60)]
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=1).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    from skein.llm.line_dedup import dedup_lines

    rows = [(None, "first of all lines", 1, 2), (None, "another line of text", 3, 4), (7, "first of all lines", 5, 6), (7, "seven has two texts", 5, 6), (7, "seven has two texts", 5, 6), (8, None, 0, 0), (9, "", 0, 0), (10, "seven has two texts\nanother line of text\nnew words here", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_removed int, cid int")
    out = dedup_lines(docs, k=1, removed_col="gone_lines")
    assert out.columns == [*docs.columns, "_n_lines", "gone_lines"]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["gone_lines"], r["_n_removed"]) for r in out.collect())
    assert got == [(False, 0, "another line of text", 0, 3), (False, 0, "first of all lines", 0, 1), (True, 7, "", 1, 5), (True, 7, "seven has two texts", 0, 5), (True, 7, "seven has two texts", 0, 5), (True, 8, "", 0, 0), (True, 9, "", 0, 0), (True, 10, "new words here", 2, 0)]
    assert out.filter("doc_id = 8 and text is null and _n_lines = 0").count() == 1
    assert dedup_lines(docs.limit(0), k=1).count() == 0


def test_bitmaps_bound_the_overlap():
    from skein.llm.line_dedup import bitmaps

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 5, 40, 300)] * 3
    sets += [np.union1d(x[: len(x) // 2], rng.integers(0, 1 << 60, 9).astype(np.uint64)) for x in sets]
    start = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    lo, hi = bitmaps(np.concatenate(sets), start)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = int(np.bitwise_count(lo[i] ^ lo[j])) + int(np.bitwise_count(hi[i] ^ hi[j]))
            assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - apart) // 2


def test_line_rows_go_before_the_texts_are_joined(spark, monkeypatch):
    from pathlib import Path

    from skein.llm import line_dedup as ld

    made = []

    class Seen(ld.Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self)

    monkeypatch.setattr(ld, "Scratch", Seen)
    out = ld.dedup_lines(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string"), k=1)
    root = Path(made[0].root.removeprefix("file://"))
    assert root.is_dir() and not (root / "1").exists()  # the rows of all lines are cut first
    assert {r["doc_id"]: r["_n_removed"] for r in out.collect()} == {1: 0, 2: 1, 3: 0}
