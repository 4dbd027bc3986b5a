import struct

import pytest

from skein.sinks import batched_lines, write_bel, write_gr
from skein.sources import read_batched_text, read_bel, read_commercial, read_cyber, read_edge_list, read_uses
from skein.sources.edges import batch_count
from skein.sources.trade_csv import uid


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize(("text", "want", "n"), [("1 2\n1 3\n1 4\n\n2 3 4\n", [(0, 1, 2), (0, 1, 3), (0, 1, 4), (1, 2, 3), (1, 2, 4)], 2), ("1 2\n\n", [(0, 1, 2)], 1), ("1 2 \n7\n", [(0, 1, 2)], 1)])
def test_batched_text(spark, tmp_path, text, want, n):
    path = put(tmp_path, "b.txt", text)
    assert sorted(map(tuple, read_batched_text(spark, path).collect())) == want
    assert batch_count(spark, path) == n


def test_batched_lines(spark):
    e = spark.createDataFrame([(0, 2, 1), (0, 0, 3), (0, 0, 1), (1, 1, 0), (1, 0, 2)], "batch int, src long, dst long")
    assert sorted((r["batch"], r["line"]) for r in batched_lines(e).collect()) == [(0, "0 1 3"), (0, "2 1"), (1, "0 2"), (1, "1 0")]


def test_binary(spark, tmp_path):
    e = spark.createDataFrame([(0, 3, 9), (1, 0, 1 << 40), (2, 255, 10)], "edge_idx long, src long, dst long")
    write_bel(e, str(tmp_path / "bel"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "bel").glob("part-*")))
    assert raw == struct.pack("<6Q", 3, 9, 0, 1 << 40, 255, 10)
    (tmp_path / "one.bel").write_bytes(raw)
    assert sorted(map(tuple, read_bel(spark, str(tmp_path / "one.bel")).collect())) == [(0, 3, 9), (1, 0, 1 << 40), (2, 255, 10)]
    (tmp_path / "bad.bel").write_bytes(raw[:24])
    with pytest.raises(ValueError):
        read_bel(spark, str(tmp_path / "bad.bel"))
    small = spark.createDataFrame([(0, 1), (2, 0)], "src long, dst long")
    write_gr(small, 3, str(tmp_path / "gr"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "gr").glob("part-*")))
    assert struct.unpack("<9Q", raw) == (2, 0, 3, 2, 1, 1, 2, 1, 0)


def test_csv(spark, tmp_path):
    c = put(tmp_path, "c.csv", "#head\nSale,1552474,1928788,,8/21/2018,,,\nSale,299156,458364,8486,,,,3.0366367403882406\ninvalid,,,1,2,,,2/11/2018,,\n")
    rows = {(r["type"], r["src"], r["dst"], r["topic"], r["amount"]) for r in read_commercial(spark, c).collect()}
    assert rows == {("SALE", 1552474, 1928788, 0, 0.0), ("PURCHASE", 1928788, 1552474, 0, 0.0), ("SALE", 299156, 458364, 8486, 3.0366367403882406), ("PURCHASE", 458364, 299156, 8486, 3.0366367403882406)}
    y = read_cyber(spark, put(tmp_path, "y.csv", "0,217661,172800,0,6,26890,94857,6,5,1379,1770\n"))
    from pyspark.sql import functions as F

    assert y.select(uid(F.col("dst_type"), F.col("dst"))).first()[0] == (2**63 - 1) + 217661
    assert read_uses(spark, put(tmp_path, "u.csv", "12,311784\n")).select("type", "src", "dst").first() == ("USES", 12, 311784)
    assert sorted(map(tuple, read_edge_list(spark, put(tmp_path, "e.txt", "# x\n1 2\n3 4\n")).collect())) == [(1, 2), (3, 4)]


def test_stream(spark, tmp_path):
    from skein.operators import GraphStore
    from skein.streaming import read_edge_stream, replay

    for i, rows in enumerate([[(0, 1), (1, 2)], [(0, 2)]]):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    out = []
    stream = read_edge_stream(spark, str(tmp_path / "in" / "*"))
    replay(stream, GraphStore(spark), lambda i, df: out.append(df.first()[0]), str(tmp_path / "ck"), "tc").awaitTermination()
    assert out[-1] == 1
