import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec import queries
from lodevec.operators import exact, literals
from lodevec.plans import regexplan


def made(rng):
    w = lambda: "".join(rng.choice("abAk") for _ in range(rng.randint(1, 3)))
    arm = lambda: rng.choice(["", "^"]) + w() + rng.choice(["", ".*" + w()]) + rng.choice(["", "$"])
    return "|".join(arm() for _ in range(rng.randint(1, 3)))


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_rows_are_those_of_the_expression(case_sensitive):
    rng = random.Random(3)
    patterns = sorted({made(rng) for _ in range(400)}) + ["a+b", "[ab]k", "aba?k"]
    texts = ["".join(rng.choice("abABk \néK") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "\n", "", "ab"]
    ready = literals.Patterns(patterns, case_sensitive)
    assert len(ready.other) == 3
    for some in (texts, [t for t in texts if t is None or "\n" not in t], [None, ""], []):
        block = ready.block(pa.array([None, *some], "string").slice(1))
        for i, p in enumerate(patterns):
            search = regexplan.compiled(p, case_sensitive).search
            assert block.rows(i).tolist() == [k for k, t in enumerate(some) if t is not None and search(t)], p


def test_blocks_hold_all_rows(monkeypatch):
    monkeypatch.setattr(literals, "BLOCK_BYTES", 200)
    rows = pa.table({"str": [("x" * (i % 40)) if i % 7 else None for i in range(1000)], "id": range(1000)})
    got = list(literals.blocks(rows.to_batches(max_chunksize=90), 30))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(1000)) and max(map(len, got)) <= 30


def test_workload_patterns_need_no_expression(spark, sf):
    """a generated workload's patterns are all answered from where their words stand."""
    made = [r.regex for r in queries.QUERIES["query_gen_candidates"](spark, sf).collect()]
    assert made and all(map(regexplan.arms, made))


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_many_patterns_equal_few(spark, metric):
    """More patterns than the JVM's mask holds give what each would alone; equal vectors, nulls and short ones too."""
    rng = np.random.default_rng(1)
    words = [a + b for a in "abcdefgh" for b in "klmnopqr"]
    vec = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(600)]
    vec[5], vec[6], vec[7] = None, [1.0], [0.0] * 4
    rows = [(i, None if i % 50 == 3 else " ".join(rng.choice(words, 12)), v, int(rng.integers(3)) if i % 40 else None) for i, v in enumerate(vec)]
    c = spark.createDataFrame(rows, "id long, str string, vec array<float>, build_id int").repartition(3)
    q = [(i, f"{w}.*{words[i - 1]}|^{w}" if i % 2 else w, vec[i + 10], i % 3 if i != 9 else None) for i, w in enumerate(words)]
    q.append((99, "ak|k+l", vec[40], 1))
    q = spark.createDataFrame(q, "qid long, regex string, qvec array<float>, build_id int")
    many = sorted(map(tuple, exact.groundtruth(c, q, 5, metric).collect()))
    few = [tuple(r) for low in (0, 33) for r in exact.groundtruth(c, q.filter(F.col("qid").between(low, low + 32) if not low else F.col("qid") >= low), 5, metric).collect()]
    assert many == sorted(few) and len(many) > 200


def test_short_vectors_of_sources_ask_nothing(spark, sf, duck, tmp_path):
    """a source whose vector is short is in no corpus of the SQL twin; it cost a scan of its own."""
    con = duck.cursor()
    con.execute(f"copy (select id * 50 as id, build_id, text, case when id % 7 = 0 then embedding[1:8] else embedding end as embedding from items) to '{tmp_path}/items.parquet'")
    con.execute(f"create temp view items as select * from '{tmp_path}/items.parquet'")
    want = sorted(con.execute(queries.SQL["query_gen_truth"]).fetchall())
    got = sorted(map(tuple, queries.QUERIES["query_gen_truth"](spark, str(tmp_path)).select("qid", "rank", "id", "dist").collect()))
    assert want and [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
