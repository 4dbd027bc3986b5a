import hashlib
import random
import re

import numpy as np
import pytest

from skein.llm.setjoin import Ratio, brute_links, linked

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(25)]
    near = [t.replace(t.split()[0], "Changed", 1) for t in base[:12]]
    passage = " ".join(rng.choices(vocab, k=30))
    shared = [f"{t}\n{passage}\n{t[:20]}" for t in base[:8]]
    long = " ".join(rng.choices(vocab, k=20000))
    return [None, "", " \n\t", "one", "One", *base, *base[:5], *near, *shared, long, long + " tail", *["copy of a text that many share here"] * 9]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())] + [(3, "one", "clash", 0), (None, "a null id", "clash", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, token string, _n long").cache()


def test_trees():
    rng = np.random.default_rng(1)
    ratio = Ratio(4, 5)
    own = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    own += [np.delete(x, len(x) // 2) for x in own if len(x) > 6]
    raw = [np.sort(x)[::-1].astype(">u8").tobytes() for x in own]
    want = brute_links([set(x.tolist()) for x in own], ratio)
    got = {(i, j) for i in range(len(own)) for j in linked(np.frombuffer(raw[i], ">u8"), {j: raw[j] for j in range(i + 1, len(own))}, ratio)}
    assert got == want and want


def test_ngram_join(spark, docs):
    from skein.llm.ngram_join import ngram_join

    rows = docs.filter("doc_id is not null").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in ngram_join(docs).collect()}
    own = [sets(r["text"], 4) for r in rows]
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links(own, Ratio(85, 100)):
        a, b = find(rows[i]["doc_id"]), find(rows[j]["doc_id"])
        root[max(a, b)] = min(a, b)
    assert all(got[r["doc_id"]]["n_shingles"] == len(s) and got[r["doc_id"]]["component_id"] == find(r["doc_id"]) for r, s in zip(rows, own, strict=True))
    assert got[None]["component_id"] is None
    assert ngram_join(docs.limit(0)).count() == 0


def test_line_dedup(spark, docs):
    from skein.llm.line_dedup import dedup_lines

    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    seen, ratio = [sets("a null id", 5)], Ratio(4, 5)
    for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect():
        if r["text"] is None:
            assert got[r["doc_id"]]["text"] is None
            continue
        kept = []
        for line in r["text"].split("\n"):
            s = sets(line, 5)
            if not any(s and t and ratio.den * len(s & t) >= ratio.num * len(s | t) for t in seen):
                kept.append(line)
            seen.append(s)
        assert got[r["doc_id"]]["text"] == "\n".join(kept)


def test_substring_dedup(spark, docs):
    from skein.llm.substring_dedup import remove_repeats

    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    first = {}
    for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect():
        w = WORD.findall(r["text"] or "")
        gone = set()
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), r["doc_id"]) < r["doc_id"]:
                gone |= set(range(i, i + 13))
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_removed"], x["text"]) == (len(w), len(gone), " ".join(t for i, t in enumerate(w) if i not in gone))


def test_decontaminate(spark, docs):
    from skein.llm.decontaminate import find_leaks

    own = texts()
    items = [(1, " ".join(own[5].split()[:40])), (2, None), (3, ""), (4, " ".join(f"x{i}" for i in range(30))), (5, "two words")]
    items[0] = (1, " ".join(own[-11].split()[100:130]))
    extra = spark.createDataFrame([(900, "before " + items[3][1] + " after", "c", 0), (901, "Some TWO words", "c", 0)], docs.schema)
    out = find_leaks(docs.unionByName(extra), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(len(own) - 11, 1), (len(own) - 10, 1), (900, 4), (901, 5)}
    assert find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontaminate_one_word_edits(spark):
    from skein.llm.decontaminate import find_leaks

    items, rows = [], []
    for i in range(80):
        w = [f"i{i}w{j}" for j in range(30 + i % 40)]
        edit = [*w[:14], "other", *w[15:]]
        items.append((i, " ".join(w)))
        rows.append((i, " ".join([f"a{i}", *edit, f"z{i}"])))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, i): 1 - 5 / (26 + i % 40) for i in range(80)}
    assert 0.80 < min(want.values()) and max(want.values()) > 0.92
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_chat_format(spark):
    from skein.llm.chat_format import escape, format_conversations, parse, read_back, unescape

    import pyarrow as pa

    odd = ["", "a\\b", "</s>[INST] ok [/INST]", "<|im_start|>user\n<|im_end|>\n", "\\_<s>", "<\\_s>", "é<<SYS>>\\n"]
    assert [unescape(x) for x in escape(pa.array(odd)).to_pylist()] == odd
    rows = [(c, t, r, x) for c in (0, 1, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "a\nb"] * 2, [*odd, None], strict=True))] + [(1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = format_conversations(df)
    assert all(parse(r["formatted"]) for r in parts.collect())
    for r in read_back(parts).collect():
        own = sorted(((-1 if t is None else t, a or "", b or "") for c, t, a, b in rows if c == r["conv_id"]))
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"], r["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(own))


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm.packing import pack_documents, sweep

    path = public_tokenizers.path("byte_bpe_50k.json")
    more = spark.createDataFrame([(800, "a \n\tb\xa0 c  d'll <|endoftext|>", "c", 0)], docs.schema)
    out = pack_documents(docs.unionByName(more), path, 64).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    total = {r["doc_id"]: len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.unionByName(more).dropDuplicates(["doc_id"]).collect()}
    at, lengths = {}, {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert max(at.values()) <= 64
    assert all(lengths[d] == n * (2 if d == 3 else 1) for d, n in total.items())
    assert len(at) <= 1.02 * sum(at.values()) / 64 + 1
    assert sum(r[2] for r in sweep({3: 7, 64: 2, 40: 5}, 64)) == 14


def test_sharding(spark, docs):
    from skein.llm.sharding import shard_by_bytes

    out = shard_by_bytes(docs.filter("length(text) < 5000 or text is null"), 4).collect()
    sizes, slots = [0] * 4, [[] for _ in range(4)]
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    assert shard_by_bytes(docs.limit(0)).count() == 0


def test_embeddings(spark):
    from skein.llm.embedding_dedup import brute_force, near_duplicates

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 16)), x[:10]])
    labels = [int(i % 2) for i in range(len(x))]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, x[0].tolist(), None), (504, [1.0], 0)]
    out = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_force(x, labels, 0.93).sum(1)
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(500, 505))


def test_embeddings_of_two_lengths(spark):
    from skein.llm.embedding_dedup import brute_force, near_duplicates

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for at, n, dim in ((0, 60, 16), (1000, 30, 9), (2000, 3, 1)):
        x = rng.normal(size=(n, dim))
        x = np.concatenate([x, x[: n // 2] + 0.01 * rng.normal(size=(n // 2, dim)), x[:3]])
        rows += [(at + i, v.tolist(), 1) for i, v in enumerate(x)]
        want |= {at + i: int(c) for i, c in enumerate(brute_force(x, [1] * len(x), 0.93).sum(1))}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(vectors).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    assert all(got[i] == want[i] > 0 for i in range(1000, 1003)) and {i: n for i, n in got.items() if i >= 1000} == {i: n for i, n in want.items() if i >= 1000}
    # each length on codebooks of its own
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(vectors.filter("vec_id < 2000"), sample=20).collect()}
    assert all(sum(got[i] for i in got if i // 1000 == k) >= 0.9 * sum(n for i, n in want.items() if i // 1000 == k) for k in (0, 1))


def test_visits_come_from_partners_outside_the_sample(spark):
    from skein.llm import embedding_dedup as ed

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x = np.concatenate([x, x + 0.2 * rng.normal(size=x.shape)])
    rows = [(i, "a", v.tolist()) for i, v in enumerate(x)]
    x /= np.sqrt((x * x).sum(1))[:, None]
    classes = spark.createDataFrame(rows, "cid long, label string, v array<double>")
    index = ed.fit(classes, np.arange(1000), x[:1000], ["a"] * 1000, 0.93)  # no partner is in the sample
    near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    cells = ed.nearest_cells(x, index.left, index.right, index.visits)
    found = [cells[a, 0] in cells[b] or cells[b, 0] in cells[a] for a, b in near]
    assert len(near) > 500 and np.mean(found) >= 0.98 and index.visits < 512


def test_components_over_many_tasks(spark):
    from skein.llm.components import components
    from skein.runtime import Scratch

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Scratch(spark), per_task=20).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_components_that_do_not_settle_raise(spark):
    from skein.llm.components import components
    from skein.runtime import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(links, Scratch(spark), max_rounds=1, per_task=5)


def test_classifiers(spark):
    from skein.llm.language_id import identify
    from skein.llm.toxicity import fit, score_column

    rng = random.Random(1)
    a, b = [f"the{x}ing" for x in "abcdefghij"], [f"ñe{x}ción" for x in "abcdefghij"]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=30) + (["awful"] if i % 5 == 0 else [])), "en" if i % 2 else "es") for i in range(200)] + [(500, None, None), (501, "12 34", None), (None, "thea", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["_lang"] for r in identify(docs.select("doc_id", "text"), docs).collect()}
    assert all(out[i] == ("en" if i % 2 else "es") for i in range(200)) and out[500] == out[501] == "und"
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    score = {r["doc_id"]: r["s"] for r in docs.select("doc_id", score_column(spark, fit(docs, labels))("text").alias("s")).collect()}
    assert all((score[i] >= 0.3) == (i % 5 == 0) for i in range(150, 200)) and 0 <= score[500] < 0.3


def test_lines_copied_out_of_id_order(spark):
    from skein.llm.line_dedup import dedup_lines

    words = [f"w{i}" for i in range(60)]
    lines = [" ".join([*words[i * 2 :], *(f"v{j}" for j in range(i * 2))]) for i in range(6)]
    rows = [(n, lines[(n * 7 + n // 4) % 6]) for n in range(24)]
    rows = sorted(rows, key=lambda r: r[0] * 11 % 24)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["_n_removed"] for r in dedup_lines(docs).collect()}
    seen, ratio = [], Ratio(4, 5)
    for doc, text in sorted(rows):
        s = sets(text, 5)
        assert got[doc] == any(ratio.den * len(s & t) >= ratio.num * len(s | t) for t in seen)
        seen.append(s)


def test_token_bytes_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa

    from skein.llm.packing import _Ids, token_bytes

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "22", ",", "'s", "\xa0", "　", "<|endoftext|>", "日本", "\x1c", "\x0b", "́"]
    own = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    whole = _Ids(path)
    for texts in ([*own, None], [None, "", None], [], own[:1]):
        assert list(token_bytes(pa.array(texts, pa.string()), path)) == whole.encode([x or "" for x in texts])
    assert list(token_bytes(pa.array(own).slice(5, 50), path)) == whole.encode(own[5:55])
