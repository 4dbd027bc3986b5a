"""What op8 puts on disk, and starts that repeat within documents."""

import random
import time

import pytest
from pyspark.sql import functions as F


def shuffle_mb(spark):
    """Shuffle data on disk now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")) / 1e6


def settled(spark, limit):
    """What is left after the cleaner had time; it returns early below the limit."""
    for _ in range(40):
        if (now := shuffle_mb(spark)) < limit:
            break
        time.sleep(0.25)
    return now


def test_the_windows_shuffle_is_small_and_gone_before_the_texts_are_joined(spark):
    from skein.llm.substring_dedup import remove_repeats

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=300)) for _ in range(400)]
    # every window occurs in four tasks, so no task settles any
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, t) for i, t in enumerate(texts * 4)], 4), "doc_id long, text string")
    store = spark._jsc.sc().statusStore()
    spark.sparkContext._jvm.System.gc()
    before = settled(spark, 0.01)
    known = {s.stageId() for s in stages(store)}
    out = remove_repeats(docs)
    time.sleep(1)
    most = max(s.shuffleWriteBytes() for s in stages(store) if s.stageId() not in known)
    windows = 4 * 400 * 288
    assert most / windows < 30, f"{most / windows:.1f} bytes a window"
    assert most / 1e6 > 5 and settled(spark, before + most / 4e6) < before + most / 4e6
    got = out.groupBy((F.col("doc_id") < 400).alias("first")).agg(F.sum("n_removed").alias("n")).collect()
    assert {r["first"]: r["n"] for r in got} == {True: 0, False: 3 * 400 * 300}


def stages(store):
    found = store.stageList(None, False, False, spark_doubles(store), None)
    return [found.apply(i) for i in range(found.size())]


def spark_doubles(store):
    from pyspark import SparkContext

    return SparkContext._gateway.new_array(SparkContext._jvm.double, 0)


@pytest.mark.parametrize("held", [None, 40])
def test_passages_that_repeat_within_documents(spark, monkeypatch, held):
    from skein.llm import substring_dedup
    from skein.llm.substring_dedup import remove_repeats

    if held:
        monkeypatch.setattr(substring_dedup, "HELD", held)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    passages = [rng.choices(vocab, k=n) for n in (13, 14, 20, 30)]
    rows = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 4)):
            w += [*rng.choice(passages), *rng.choices(vocab, k=rng.randint(0, 3))]
        rows.append((i, " ".join(w)))
    first, want = {}, {}
    for i, text in rows:
        w, gone = text.split(), set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    rng.shuffle(rows)
    for tasks in (1, 5):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string")
        assert {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()} == want


def test_what_a_task_holds_of_windows_does_not_grow_with_its_input():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from skein.llm.substring_dedup import suspects

    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=400)) for _ in range(100)]

    def peak(batches):
        table = (pa.RecordBatch.from_arrays([pa.array(range(i * 100, i * 100 + 100)), pa.array(texts), pa.array([7] * 100)], names=["doc", "text", "mark"]) for i in range(batches))
        tracemalloc.start()
        rows = sum(len(out) for out in suspects(table, lambda: np.full((2, 1 << 19), 255, np.uint8), 13, 6, 1 << 16))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most

    few, many = peak(4), peak(40)
    assert many[0] > few[0] and many[1] < 1.5 * few[1], (few, many)
