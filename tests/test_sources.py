import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.operators import exact
from lodevec.sources import binary, store, textio
from lodevec.streaming import query_stream


def write(path, rows, kind):
    with open(path, "wb") as f:
        for r in rows:
            f.write(struct.pack("<i", len(r)) + np.array(r, kind).tobytes())


@pytest.mark.parametrize(("fmt", "kind"), [("fvecs", "<f4"), ("bvecs", "u1"), ("ivecs", "<i4")])
def test_round_trip(spark, tmp_path, fmt, kind, monkeypatch):
    rows = [[i, i + 1, 255 - i] for i in range(50)]
    write(tmp_path / "a", rows, kind)
    monkeypatch.setattr(binary, "SPLIT_BYTES", 100)
    df = binary.read_vectors(spark, str(tmp_path / "a"), fmt)
    assert df.rdd.getNumPartitions() > 1
    assert {r.id: list(r.vec) for r in df.collect()} == dict(enumerate(rows))
    assert binary.count_vectors(str(tmp_path / "a"), fmt) == (50, 3)
    binary.write_vectors(df.repartition(3), str(tmp_path / "out"), fmt)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == (tmp_path / "a").read_bytes()


def test_fbin_and_bad_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "b").write_bytes(struct.pack("<ii", 4, 3) + x.tobytes())
    assert [list(r.vec) for r in binary.read_vectors(spark, str(tmp_path / "b"), "fbin").orderBy("id").collect()] == x.tolist()
    (tmp_path / "cut").write_bytes((tmp_path / "b").read_bytes()[:-2])
    (tmp_path / "none").write_bytes(b"")
    with pytest.raises(ValueError):
        binary.read_vectors(spark, str(tmp_path / "cut"), "fbin")
    with pytest.raises(ValueError):
        binary.read_vectors(spark, str(tmp_path / "b"), "nosuch")
    assert binary.read_vectors(spark, str(tmp_path / "none"), "fvecs").count() == 0
    write(tmp_path / "mixed", [[1.0, 2.0, 3.0], [1.0]], "<f4")
    (tmp_path / "mixed").write_bytes((tmp_path / "mixed").read_bytes() + b"\0" * 8)
    with pytest.raises(Exception, match="dimension"):
        binary.read_vectors(spark, str(tmp_path / "mixed"), "fvecs").collect()


def test_query_lines(spark):
    lines = spark.createDataFrame([(0, "red|blue 1.5 -2"), (1, "only"), (2, ""), (3, "a b\t[1,2,3]"), (4, "x 1 two"), (5, None)], "id long, value string")
    got = {r.qid: (r.regex, list(r.qvec)) for r in textio.parse_queries(lines).collect()}
    assert got == {0: ("red|blue", [1.5, -2.0]), 3: ("a b", [1.0, 2.0, 3.0])}
    with pytest.raises(ValueError):
        textio.dimensions(textio.parse_queries(lines))


def test_strings_and_results(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one\n\nthree\n")
    assert {r.id: r.str for r in textio.load_strings(spark, str(tmp_path / "s.txt")).collect()} == {0: "one", 1: "", 2: "three"}
    many = spark.range(1000).select(F.col("id").cast("string").alias("value")).repartition(5)
    numbered = textio.with_line_numbers(many)
    assert sorted(r.id for r in numbered.collect()) == list(range(1000))
    q = spark.createDataFrame([(0,), (1,)], "qid long")
    res = spark.createDataFrame([(0, 2, 7), (0, 1, 9)], "qid long, rank long, id long")
    lines = textio.format_results(q, res)
    assert {r.qid: r.value for r in lines.collect()} == {0: "9 7", 1: ""}
    assert sorted(map(tuple, textio.parse_results(lines.withColumnRenamed("qid", "id")).collect())) == [(0, 1, 9), (0, 2, 7)]


def test_store(spark, tmp_path):
    m = spark.createDataFrame([(1, 0), (2, 1)], "id long, cluster_id int")
    g = spark.createDataFrame([("abc", 0)], "gram string, cluster_id int")
    store.save({"membership": m, "gram_index": g}, str(tmp_path / "ix"), 2, k=2)
    got = store.load(spark, str(tmp_path / "ix"), 2, k=2)
    assert sorted((r.id, r.cluster_id) for r in got["membership"].collect()) == [(1, 0), (2, 1)]
    with pytest.raises(store.IndexMismatch):
        store.load(spark, str(tmp_path / "ix"), 3)
    with pytest.raises(store.IndexMismatch):
        store.load(spark, str(tmp_path / "nothing"))
    plan = got["membership"].join(F.broadcast(g.filter("gram = 'abc'").select("cluster_id")), "cluster_id", "left_semi")
    assert "dynamicpruning" in plan._jdf.queryExecution().toString().lower()


def test_query_stream(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "red", [1.0, 0.0]), (1, "blue", [0.0, 1.0])], "id long, str string, vec array<float>")
    q = spark.createDataFrame([(0, "red|blue", [0.0, 1.0])], "qid long, regex string, qvec array<float>")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    query_stream.answer(stream, corpus, str(tmp_path / "out"), str(tmp_path / "cp"), k=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rank")
    assert [r.id for r in got.collect()] == [r.id for r in exact.groundtruth(corpus, q, 2).orderBy("rank").collect()] == [1, 0]
