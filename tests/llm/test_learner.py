"""What the toxicity learner holds."""

import tracemalloc

import numpy as np


def test_state_follows_the_features_that_occur():
    from skein.llm.toxicity import BITS, ftrl

    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(0, 1 << BITS, 300)) for _ in range(50)]
    docs = [np.unique(np.append(x, (1 << BITS) - 1 - i % 2)).astype(np.int32) for i, x in enumerate(docs)]
    y = np.arange(50) % 2
    tracemalloc.start()
    model = ftrl(docs, y, np.ones(50), l1=0.5)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, f"{peak:.0f} MB"
    top = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert (np.diff(model.features) > 0).all() and (model.weights != 0).all()
    assert top[(1 << BITS) - 2] > 0 > top[(1 << BITS) - 1]


def test_packing_gives_freed_memory_back(spark, monkeypatch):
    import public_tokenizers

    from skein.llm import blocks, packing

    given, whole = [], blocks.trimmed
    monkeypatch.setattr(blocks, "trimmed", lambda run: given.append(run.__name__) or whole(run))
    docs = spark.createDataFrame([(i, f"some words {i} " * 50) for i in range(20)], "doc_id long, text string")
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, end_id=2)
    assert out.select("doc_id").distinct().count() == 20 and "run" in given


def test_scoring_reads_arrow_texts(spark):
    from pyspark.util import PythonEvalType

    from skein.llm.toxicity import Model, score_column

    score = score_column(spark, Model(np.zeros(0, np.int64), np.zeros(0), 0.0))
    assert score.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # no text becomes a Python object
    docs = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r[0] for r in docs.select(score("t")).collect()] == [0.5] * 3
