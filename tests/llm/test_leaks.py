"""Every position of a document is compared with the benchmark's items."""

import math
import random

from tests.llm.test_rules import plain_windows


def best_windows(rows, items, k=5):
    """{(doc, item): (similarity, positions that have it)} over all windows, by sets."""
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    df = {}
    for _, text in items:
        for s in shingles(text.split()):
            df[s] = df.get(s, 0) + 1
    top = max(1, round(32 * math.log(1 + len(items))))
    weight = lambda s: max(1, round(math.log((1 + len(items)) / df[s]) * 32)) if s in df else top
    norm = lambda s: sum(weight(x) ** 2 for x in s)
    out = {}
    for d, text in rows:
        for i, item in items:
            own = shingles(item.split())
            found = [shingles(w) for w in plain_windows(text, len(item.split()))]
            sims = [norm(own & s) / math.sqrt(norm(own) * norm(s)) if s else 0 for s in found]
            if sims and max(sims) >= 0.8:
                out[(d, i)] = (max(sims), {j for j, x in enumerate(sims) if x > max(sims) - 1e-12})
    return out


def test_windows_that_no_shared_shingle_sets_in_place(spark, monkeypatch):
    from skein.llm import decontaminate as dc

    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(60, 110)))) for i in range(12)]
    w = items[0][1].split()
    items.append((12, " ".join([*w[:40], *w[:40], *w[40:]])))  # its shingles repeat
    rows = []
    for i, text in items:
        w, h = text.split(), len(text.split()) // 2
        pad = lambda: rng.choices(vocab, k=rng.randint(0, 90))
        t = len(w) // 3
        rows += [(len(rows) + j, " ".join(x)) for j, x in enumerate([
            [*pad(), *w[h:], *w[:h], *pad()],  # halves changed over
            [*pad(), *w[t:], *pad()[:3], *w[:t], *pad()],
            [*w[h:], *w[:h]], w[h:] + w[h:] + w[:h] + w[:h], w[: len(w) - 7],
            [*pad(), *w, *pad()[:20], *w[::-1], *w[5:], *pad()],
        ])]
    want = best_windows(rows, items)
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(docs, bench).collect()}

    got = found()
    assert {i for d, i in got if d is None} == {i for d, i in want if d == 0}
    got = {x: r for x, r in got.items() if x[0] is not None}
    assert got.keys() == want.keys() and len({d for d, _ in want}) > 50
    assert all(abs(r["similarity"] - want[x][0]) < 2e-6 and r["start"] in want[x][1] for x, r in got.items())
    monkeypatch.setattr(dc, "MAX_BROADCAST", 0)  # the same by shuffle joins alone
    again = found()
    assert all(again[x] == r for x, r in got.items())
