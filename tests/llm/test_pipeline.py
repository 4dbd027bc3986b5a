import random

import pytest

import corpus_pipeline as cp
from skein.llm.setjoin import Ratio, brute_links

VOCAB = [f"w{i}" for i in range(5000)]
ITEM = " ".join(f"b{i}" for i in range(30))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def rows():
    rng = random.Random(7)
    t = [" ".join(rng.choices(VOCAB, k=60)) for _ in range(12)]
    near = [x.replace(x.split()[0], "other", 1) for x in t]
    leak = f"{t[9]} {ITEM} {t[10]}"
    ids = [(1, t[0]), (1, t[1]), (1, t[1]), (2, near[0]), (3, t[2]), (3, near[2]), (3, t[3]), (4, near[3]), (5, t[4]), (6, near[4]), (8, None), (8, None), (9, ""), (9, " ")]
    return [*ids, (None, t[5]), (None, t[6]), (None, near[6]), (None, None), (10, near[5]), (11, leak), (11, t[7]), (None, leak + " end"), (None, t[8])]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows()], "doc_id long, text string, _keep string, _gone string, key string")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def deduped(own):
    """Rows that stay: those without an id, and one row of each group's smallest id (a null is smaller)."""
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links([shingles(t) for _, t in own], Ratio(80, 100)):
        root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, row in enumerate(own):
        groups.setdefault(find(i) if shingles(row[1]) else row, []).append(row)
    return [min((r for r in g if r[0] is not None), key=lambda r: r[0]) for g in groups.values() if all(r[0] is not None for r in g)], [r for r in own if r[0] is None]


def test_ngram_dedup_keeps_rows_of_null_and_repeated_ids(spark, data):
    docs, path = data
    out = cp.ngram_dedup(spark, docs, path)
    assert out.columns == docs.columns
    kept, null = deduped(rows())
    got = pairs(out)
    # of two near texts under one smallest id either may stay
    name = lambda r: (r[0], frozenset(shingles(r[1])) if r[0] != 3 else (r[1] or "").split()[1], r[1] if not shingles(r[1]) else "")
    assert sorted((name(r) for r in got), key=str) == sorted((name(r) for r in kept + null), key=str)
    assert cp.ngram_dedup(spark, docs.limit(0), path).count() == 0


def test_decontamination_judges_rows(spark, data):
    docs, path = data
    out = cp.decontamination(spark, docs, path)
    assert pairs(out) == sorted((r for r in rows() if ITEM not in (r[1] or "")), key=str)
    assert cp.decontamination(spark, docs.limit(0), path).count() == 0


def lines_deduped(own):
    """Later near-duplicate lines go, then documents of which no line is left; a null id comes first."""
    seen, out = [], []
    for i, text in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            s = set(line.lower().split())
            if not any(s and len(s & t) * 5 >= len(s | t) * 4 for t in seen):
                kept.append(line)
            seen.append(s)
        if kept and (any(x.strip() for x in kept) or len(kept) == len((text or "").split("\n"))):
            out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_run_and_every_stage(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = [f"the{x}{y}ing" for x in "abcdefghij" for y in "abcdef"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    own = [(i, text(40) + (" awful awful" if i % 5 == 0 else "")) for i in range(200)]
    shared, near = text(30), text(60).split()
    own += [(301, f"{text(20)}\n{shared}"), (302, f"{text(20)}\n{shared}"), (303, shared), (None, text(30)), (None, text(25)), (None, None), (304, None)]
    # near as documents, not line by line
    own += [(310, "\n".join(" ".join(near[i : i + 3]) for i in range(0, 60, 3))), (311, " ".join(near)), (312, text(30)), (312, text(35)), (312, f"{text(10)} {ITEM}")]
    path = str(tmp_path)
    docs = spark.createDataFrame(own, "doc_id long, text string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    want = [r for r in own if "awful" not in (r[1] or "")]
    assert pairs(cp.toxicity(spark, docs, path)) == sorted(want, key=str)
    want = lines_deduped(want)
    lines = cp.line_dedup(spark, cp.toxicity(spark, docs, path), path)
    assert pairs(lines) == sorted(want, key=str)
    want = sum(deduped(want), [])
    assert 310 in [i for i, _ in want] and 311 not in [i for i, _ in want]
    assert pairs(cp.ngram_dedup(spark, lines, path)) == sorted(want, key=str)
    want = [r for r in want if ITEM not in (r[1] or "")]
    whole, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in want:
        total[i] = total.get(i, 0) + len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in cp.run(spark, path).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def test_stages_begin_with_heap_given_back(spark, data, monkeypatch):
    from skein.runtime import Scratch

    asked, shrink = [], Scratch.shrink
    monkeypatch.setattr(Scratch, "shrink", lambda self: asked.append(1) or shrink(self))
    for _, stage in cp.STAGES[2:4]:
        assert stage(spark, data[0].limit(0), data[1]).count() == 0
    assert len(asked) == 2


def test_workers_forget_what_packing_keeps(spark):
    import public_tokenizers
    import pyarrow as pa

    from skein.llm import blocks, packing

    list(packing.token_bytes(pa.array(["a text of words"]), public_tokenizers.path("byte_bpe_50k.json")))

    def run(batches):
        yield from batches

    run.__module__ = packing.__name__
    assert list(blocks.trimmed(run)([1])) == [1] and packing._held  # the next task of its own finds it
    run.__module__ = "skein.llm.line_dedup"
    assert list(blocks.trimmed(run)([1])) == [1] and not packing._held
