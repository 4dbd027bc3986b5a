"""Operators against plain Python versions, and rows of odd kinds."""

import math
import random
import zlib

import numpy as np

from tests.llm.test_operators import LOWER, WORD


def test_sketch_levels_give_one_sketch(spark, monkeypatch):
    from skein.llm import sketch as S

    rng = np.random.default_rng(3)
    values = rng.integers(0, 400, 6000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")

    def hashes(batch):
        yield batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    want = S.build(df.repartition(2), hashes, 16, 2)
    monkeypatch.setattr(S, "FAN", 3)
    assert (S.build(df.repartition(11), hashes, 16, 2) == want).all() and want.max() > 3
    count = np.bincount(values, minlength=400)
    got = S.log_counts(want, np.arange(400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (got >= np.ceil(np.log2(count + 1.0))).all() and (got == np.ceil(np.log2(count + 1.0))).mean() > 0.95


def test_components_and_kept_of_embeddings(spark):
    from skein.llm.embedding_dedup import brute_force, codewords, near_duplicates

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 12))
    x = np.concatenate([x, x[:30] + 0.04 * rng.normal(size=(30, 12)), x[:6]])
    scale = np.where(np.arange(len(x)) % 3 == 0, 1e200, np.where(np.arange(len(x)) % 3 == 1, 1e-200, 1.0))
    rows = [(i, (v * s).tolist(), "a" if i % 7 else "b") for i, (v, s) in enumerate(zip(x, scale, strict=True))]
    rows += [(500, [1e-200, 1e-200], "a"), (501, [1.0, 10.0], "a"), (502, [1e200, 1e200], "a"), (503, [5e-324, 5e-324], "a"), (None, [1.0, 1.0], "a")]
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    near = brute_force(x, ["a" if i % 7 else "b" for i in range(len(x))], 0.93)
    root = list(range(len(x)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i) for i in range(len(x)))
    assert {i: got[i]["n_links"] for i in (500, 501, 502, 503, None)} == {500: 3, 501: 0, 502: 3, 503: 3, None: 3}
    assert codewords(1000, 4) == 32 and codewords(10**7, 10) == 125 and codewords(10**12, 1) == 128


def test_repeated_ids_in_substring_dedup(spark):
    from skein.llm.substring_dedup import remove_repeats

    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(200)]
    passage = rng.choices(vocab, k=25)
    make = lambda n: " ".join([*rng.choices(vocab, k=n), *passage, *rng.choices(vocab, k=n)])
    rows = [(5, make(3)), (5, make(8)), (5, "short"), (2, make(4)), (None, "w1"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (31, 25), (33, 0), (41, 25)]
    assert remove_repeats(docs.limit(0)).count() == 0


def plain_windows(text, m):
    w = WORD.findall(text.translate(LOWER))
    return [w[i : i + m] for i in range(max(1, len(w) - m + 1))] if w else []


def test_leaks_against_all_windows(spark, monkeypatch):
    from skein.llm import decontaminate as dc

    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 60)))) for i in range(60)]
    rows = []
    for i, (_, text) in enumerate(items * 2):
        w = text.split()
        for j in rng.sample(range(len(w)), rng.randint(0, 3)):
            w[j] = "changed"
        rows.append((i, " ".join([*rng.choices(vocab, k=rng.randint(0, 30)), *w, *rng.choices(vocab, k=rng.randint(0, 30))])))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    df = {}
    for _, text in items:
        for s in shingles(text.split()):
            df[s] = df.get(s, 0) + 1
    weight = lambda s: max(1, round(math.log((1 + len(items)) / df[s]) * 32)) if s in df else max(1, round(32 * math.log(1 + len(items))))
    norm = lambda s: sum(weight(x) ** 2 for x in s)
    want = {}
    for d, text in rows:
        for i, item in items:
            own = shingles(item.split())
            found = [s for w in plain_windows(text, len(item.split())) if (s := shingles(w))]
            best = max((sum(weight(x) ** 2 for x in own & s) / math.sqrt(norm(own) * norm(s)) for s in found), default=0)
            if best >= 0.8:
                want[(d, i)] = round(best, 6)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(docs, bench).collect()}
    assert got.keys() == want.keys() and len(want) > 40 and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    monkeypatch.setattr(dc, "MAX_BROADCAST", 0)  # the same by shuffle joins alone
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(docs, bench).collect()} == got


def test_ftrl_against_a_plain_loop():
    from skein.llm.toxicity import ftrl

    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    y = np.array([float(7 in x) for x in docs])
    weight = np.where(y == 1, 2.0, 1.0)
    model = ftrl(docs, y, weight, l1=0.5, epochs=3, seed=4)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    one = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((1.0 + math.sqrt(n)) / 1.0 + 0.1)
    order = np.random.default_rng(4)
    for _ in range(3):
        for i in order.permutation(len(docs)):
            w = {f: one(z.get(f, 0.0), n.get(f, 0.0), 0.5) for f in docs[i].tolist()}
            wb = one(zb, nb, 0.0)
            p = 1 / (1 + math.exp(-(sum(w.values()) + wb)))
            g = (p - y[i]) * weight[i]
            if abs(g) < 1e-6:
                continue
            for f, v in w.items():
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) * v
                n[f] = old + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) * wb, nb + g * g
    want = {f: one(z[f], n[f], 0.5) for f in z}
    got = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert got.keys() == {f for f, v in want.items() if v} and all(abs(got[f] - want[f]) < 1e-9 for f in got)
    assert abs(model.bias - one(zb, nb, 0.0)) < 1e-9 and got[7] == max(got.values())


def test_language_model_against_plain_counts(spark):
    from skein.llm.language_id import BITS, ORDERS, _MUL, fit, identify

    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdé " if i % 2 else "cdefß ", k=40)), "x" if i % 2 else "y") for i in range(60)] + [(100, "A1é b", None), (101, None, "x"), (102, "", "y"), (None, "abab", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def buckets(text):
        out = []
        chars = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        for n in ORDERS:
            for i in range(len(chars) - n + 1):
                if chars[i] != 32:
                    h = 0
                    for k in range(n):
                        h = (h * 31 + chars[i + k] * int(_MUL[k])) & 0xFFFFFFFF
                    out.append((((h ^ h >> 15) * 0x2C1B3C6D + n * 0x9E37) & 0xFFFFFFFF) >> (32 - BITS))
        return out

    langs, logp = fit(docs)
    counts = {g: np.zeros(1 << BITS) for g in ("x", "y")}
    for i, text, g in rows:
        if i is not None and g and text:
            np.add.at(counts[g], buckets(text), 1)
    assert langs == ["x", "y"]
    want = np.stack([np.log((counts[g] + 0.1) / (counts[g] + 0.1).sum()) for g in langs], 1)
    assert np.allclose(logp, want, atol=1e-4)
    clash = docs.withColumnRenamed("lang", "_p")
    got = {r["doc_id"]: r for r in identify(clash, docs, lang_col="guess", score_col="sure").collect()}
    for i, text, _ in rows:
        total = want[buckets(text or "")].sum(0)
        best = "und" if not any(c.isalpha() for c in text or "") else langs[int(total.argmax())]
        assert got[i]["guess"] == best and (best == "und" or abs(got[i]["sure"] - 1 / np.exp(total - total.max()).sum()) < 1e-3)
    assert identify(docs.limit(0), docs).count() == 0


def test_packed_pieces_hold_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm.packing import pack_documents

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha,", "beta.", "don't", "(x)", "naïve", "a-b", "99%"], k=rng.randint(0, 90)))) for i in range(60)] + [(70, None), (71, ""), (None, "no id")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, 50).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 50 or len(own) == 1 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_shards_against_running_sums(spark, tmp_path):
    from skein.llm.sharding import _range_of, shard_by_bytes, write_shards

    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 40)) for i in range(300)] + [(None, "same"), (None, "same"), (None, None), (7, "same"), (7, "same"), (8, "é" * 900)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(5)
    placed = shard_by_bytes(docs, 5)
    out = placed.collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at = sum(r["size"] for r in out), 0
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):  # a record lies where its middle byte does
        assert r["shard"] == min((at + r["size"] - (r["size"] + 1) // 2) * 5 // total, 4)
        at += r["size"]
    write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["n"] for r in back) == list(range(len(rows)))
    assert sorted((r["shard"], r["slot"], r["doc_id"] or -1) for r in back) == sorted((r["shard"], r["slot"], r["doc_id"] or -1) for r in out)
    split = np.array(sorted([(5, 1, 2), (5, 1, 9), (5, 3, 0), (8, -4, 1)]), np.int64)
    keys = [(5, 1, 2), (5, 1, 3), (5, 0, 7), (5, 9, 9), (8, -5, 0), (8, -4, 1), (9, 0, 0), (1, 1, 1)]
    df = spark.createDataFrame(keys, "k1 long, k2 long, rid long")
    got = {(r["k1"], r["k2"], r["rid"]): r["x"] for r in df.withColumn("x", _range_of(spark, split)("k1", "k2", "rid")).collect()}
    assert all(got[k] == sum(tuple(s) <= k for s in split.tolist()) for k in keys)


def test_chat_turns_that_tie(spark):
    from skein.llm.chat_format import format_conversations, parse

    rng = random.Random(3)
    rows = [(1, 5, rng.choice(["user", "assistant", "tool"]), f"t{i} " * 40) for i in range(400)] + [(1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    turns = [t for r in sorted(format_conversations(df).collect(), key=lambda r: r["part"]) for t in parse(r["formatted"])]
    assert [r for r, _ in turns] == sorted([r or "" for _, _, r, _ in rows]) and sorted(x for _, x in turns) == sorted(x or "" for *_, x in rows)
    assert format_conversations(df.limit(0)).count() == 0


def test_scores_with_clashing_names_and_few_bytes(spark):
    from skein.llm.toxicity import fit, score_documents

    rows = [(i, "kind words here " * 3 + ("vile curse " if i % 4 == 0 else ""), 7) for i in range(120)] + [(None, "vile curse", 7), (200, "", 7), (201, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = score_documents(docs, labels, score_col="s", predicted_col="p").collect()
    assert len(out) == len(rows) and all(r["_score"] == 7 and 0 <= r["s"] <= 1 for r in out)
    assert all(r["p"] == int("vile" in (r["text"] or "")) for r in out)
    small = fit(docs, labels, max_bytes=2000)
    assert len(small.features) <= len(fit(docs, labels).features)
    assert score_documents(docs.limit(0), labels).count() == 0


def test_first_by_hash(spark):
    from skein.llm.blocks import first_by_hash, free_name

    df = spark.range(5000).toDF("i")
    want = sorted(r[0] for r in df.orderBy("i").selectExpr("i", "xxhash64(i) h").orderBy("h").limit(50).collect())
    assert sorted(r["i"] for r in first_by_hash(df, ["i"], 5000, 50).collect()) == want
    assert free_name("I", df) == "I_"
