import numpy as np
import pytest

from lodevec.llm import mixing as M


def test_pivotal_keeps_sums_and_expectations():
    p = np.array([0.3, 0.7, 0.2, 0.0, 1.0, 0.45, 0.6])
    total = np.zeros(len(p))
    for seed in range(4000):
        out, at = M.pivotal(p, np.random.default_rng(seed))
        assert abs(out.sum() - p.sum()) < 1e-9
        whole = np.delete(out, at) if at >= 0 else out
        assert set(whole) <= {0.0, 1.0}
        total += out
    assert np.abs(total / 4000 - p).max() < 0.03


def counted(spark, n=600):
    rows = [("a", i, 10 + i % 7) for i in range(n)] + [("b", 10_000 + i, 50) for i in range(40)] + [("c", 20_000 + i, 3) for i in range(10)] + [("other", 30_000, 5)]
    return spark.createDataFrame(rows, "source string, doc_id long, tokens long")


TARGETS = "source string, weight double, max_repeats int"


def test_mixture(spark):
    c = counted(spark)
    t = spark.createDataFrame([(" A ", 0.5, 2), ("b", 0.4, 5), ("c", 0.05, 4), ("none", 0.05, 3)], TARGETS)
    p = M.plan(c, t)
    plan = {r.source: r for r in p.collect()}
    assert {s: r.outcome for s, r in plan.items()} == {"a": "cut", "b": "repeated", "c": "capped", "none": "capped"}
    for block in (20_000, 50):
        m = M.mixture(c, p, 7, block, 4)
        rows = m.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in c.filter("source != 'other'").collect())
        for s, r in plan.items():
            mine = [x.copies for x in rows if x.source == s]
            assert abs(sum(mine) - r.copies * r.docs) < 1 + 1e-6
            assert all(np.floor(r.copies) <= x <= min(np.ceil(r.copies), r.max_repeats) for x in mine)
        assert sorted(map(tuple, M.mixture(c, p, 7, block, 4).collect())) == sorted(map(tuple, rows))
        got = {r.source: r for r in M.report(m, p).collect()}
        assert abs(got["a"].tokens - plan["a"].target_tokens) < 30
        assert sum(r.share for r in got.values()) == pytest.approx(1) and got["none"].tokens == 0


def test_tokens_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "Hello world", " Blog "), (2, None, "blog"), (3, "x", None), (4, "", "blog"), (5, "a b " * 20_000, "blog"), (6, "<|endoftext|>", "blog")], "doc_id long, text string, source string").selectExpr("*", "1 as tokens")
    got = {r.doc_id: (r.source, r.tokens) for r in M.with_tokens(docs).collect()}
    assert set(got) == {1, 4, 5, 6} and got[1] == ("blog", 2) and got[4][1] == 0 and got[5][1] >= 40_000 and got[6][1] > 1
    none = spark.createDataFrame([], "source string, doc_id long, tokens long")
    p = M.plan(none, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert M.mixture(none, p).count() == 0
    assert M.report(M.mixture(none, p), p).first().share == 0
    empty = M.plan(counted(spark), spark.createDataFrame([], TARGETS))
    assert M.mixture(counted(spark), empty).count() == 0
