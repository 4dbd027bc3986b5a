"""What the set join leaves on disk, and the marks that spare it sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.setjoin import Ratio, brute_links
from tests.llm.test_operators import sets

RATIO = Ratio(85, 100)


def components(rows, k):
    own, root = [sets(t, k) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, j in brute_links(own, RATIO):
            root[i] = root[j] = min(root[i], root[j])
    return {d: rows[r][0] for (d, _), r in zip(rows, root, strict=True)}


def by_chance():
    """Documents of 200 words that share a rare passage of 4 words with others, and four near copies."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    texts = [rng.choices(vocab, k=200) for _ in range(40)]
    passages = [[f"p{i}", f"q{i}", f"r{i}", f"s{i}"] for i in range(10)]
    texts = [t[: 3 * i + 5] + passages[i % 10] + t[3 * i + 5 :] for i, t in enumerate(texts)]
    texts += [t[:90] + ["changed"] + t[91:] for t in texts[:4]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.fixture
def seen(monkeypatch):
    """[(path, columns, bytes of tokens)] of all tables that the join cuts."""
    from skein.llm import setjoin

    made = []

    class Seen(setjoin.Scratch):
        def cut(self, df):
            out = super().cut(df)
            size = out.agg(F.sum(F.length("tokens"))).first()[0] if "tokens" in out.columns else 0
            made.append((out._skein_path.removeprefix("file://"), out.columns, size or 0))
            return out

    monkeypatch.setattr(setjoin, "Scratch", Seen)
    return made


def test_prefixes_and_sets_go_and_chance_candidates_need_no_sets(spark, seen):
    from pathlib import Path

    from skein.llm.ngram_join import ngram_join

    rows = by_chance()
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    left = [c for path, c, _ in seen if Path(path).exists()]
    assert left and not [c for c in left if "prefix" in c or "tokens" in c]
    want = components(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want
    assert sum(d != c for d, c in want.items()) == 4
    # sets of 200 tokens take 1,600 bytes: those of the four pairs and all marks are less than a third of all sets
    assert 0 < sum(size for _, _, size in seen) < 44 * 1600 // 3


@pytest.mark.parametrize("posted", [1, 2, 5])
def test_any_number_of_parts_gives_the_same_links(spark, monkeypatch, posted):
    from skein.llm import setjoin
    from skein.llm.ngram_join import ngram_join

    monkeypatch.setattr(setjoin, "POSTED", posted)
    monkeypatch.setattr(setjoin, "HOT", 3)
    monkeypatch.setattr(setjoin, "TREE", 2)
    rng = random.Random(8)
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randint(0, 9)}" for w in base)) for i in range(60)] + by_chance()[:5]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(100, "one"), (101, "one")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == components(rows, 4)


def test_marks_never_keep_linked_sets_apart():
    from skein.llm.setjoin import marks, not_apart

    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 2, 7, 63, 64, 65, 130, 900, 5000)]
    own += [np.union1d(x[: max(1, int(len(x) * keep))], rng.integers(0, 1 << 60, int(len(x) * more)).astype(np.uint64)) for x in own for keep, more in ((0.99, 0), (0.93, 0.07), (0.85, 0), (0.9, 0.05), (1, 0.17), (0.5, 0.5))]
    raw = marks(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
    want = brute_links([set(x.tolist()) for x in own], RATIO)
    for i in range(len(own)):
        left = set(not_apart(raw[i], dict(enumerate(raw)), RATIO))
        assert {j for a, j in want if a == i} | {j for j, a in want if a == i} | {i} <= left
        other = {j for j, x in enumerate(own) if 100 * min(len(x), len(own[i])) >= 85 * max(len(x), len(own[i])) and not len(np.intersect1d(own[i], x))}
        assert len(own[i]) < 60 or not left & other
    assert len(want) > 30
