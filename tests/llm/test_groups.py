import numpy as np
import pytest

from lodevec.llm import mixture_groups as M

SCHEMA = "id long, build_id int, vec array<float>"


def planted(sizes, dim=64, noise=0.06, loose=40, seed=1):
    """(id, build, vec) rows and the planted groups; loose rows belong nowhere."""
    rng = np.random.default_rng(seed)
    rows, groups, i = [], [], 0
    for n in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        members = []
        for _ in range(n):
            rows.append((i, 1, (c + rng.normal(size=dim) * noise).tolist()))
            members.append(i)
            i += 1
        groups.append(members)
    for _ in range(loose):
        v = rng.normal(size=dim)
        rows.append((i, 1, (v / np.linalg.norm(v)).tolist()))
        i += 1
    return rows, groups


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.build_id, r.group_id), []).append(r.id)
    return sorted(sorted(v) for v in out.values())


def test_planted_groups_come_back(spark):
    rows, groups = planted([600, 120, 40, 25, 12, 8, 3])
    bad = [(9001, 1, None), (9002, 1, [0.0] * 64), (9003, 1, [1.0] * 63), (9004, 1, [float("nan")] * 64), (9005, None, rows[0][2])]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 as k", "2 as size", "'x' as density")
    got = M.groups(df, 64)
    assert found(got) == sorted(g for g in groups if len(g) >= 5)
    assert all(r.group_id == min(groups[[r.id in g for g in groups].index(True)]) for r in got.collect())
    top = M.described(got).collect()
    assert {r.rank for r in top} == {1, 2, 3} and len(top) == 18


def test_builds_do_not_mix_and_blocks_do_not_split(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 200)
    rows, groups = planted([900, 60, 30], loose=20)
    other = [(i + 10_000, 2, v) for i, _, v in rows]
    got = M.groups(spark.createDataFrame(rows + other, SCHEMA), 64)
    assert found(got) == sorted(groups + [[i + 10_000 for i in g] for g in groups])


def test_small_and_empty(spark):
    assert M.groups(spark.createDataFrame([], SCHEMA), 64).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0] * 64)], SCHEMA)
    assert M.groups(one, 64).count() == 0
    same = spark.createDataFrame([(i, 1, [1.0] + [0.0] * 63) for i in range(6)], SCHEMA)
    assert found(M.groups(same, 64)) == [[0, 1, 2, 3, 4, 5]]


def test_density_is_that_of_a_gaussian():
    s = M.Space(np.zeros(2, "f4"), np.eye(2, dtype="f4"), np.ones(2, "f4"), np.ones(2, "?"), 10)
    m = M.Mixture(np.array([0.5]), np.array([[1.0, 0.0]], "f4"), np.array([[2.0, 0.5]], "f4"), 0.5)
    lp, bg = m.log_density(np.array([[0.0, 1.0]], "f4"), s)
    assert np.allclose(lp[0, 0], np.log(0.5) - 0.5 * (np.log(1.0) + 1 / 2 + 1 / 0.5), atol=1e-5)
    assert np.allclose(bg[0], np.log(0.5) - 0.5 * (2 * np.log(M.BROAD) + 1 / M.BROAD), atol=1e-5)


def test_clumps_of_reloaded_rows_stay_in_their_group(spark):
    rows, groups = planted([400, 90], seed=7)
    again = [(5000 + i, 1, (np.array(rows[3][2]) + np.random.default_rng(i).normal(size=64) * 0.002).tolist()) for i in range(30)]
    got = M.groups(spark.createDataFrame(rows + again, SCHEMA), 64)
    assert found(got) == sorted([sorted(groups[0] + [r[0] for r in again]), groups[1]])


def test_one_mean():
    m = np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]])
    assert M.one_mean(m, np.array([1.0, 2.0, 1.0, 1.0]), 0.7).tolist() == [1, 1, 2, 3]


@pytest.mark.parametrize("block, least", [(4096, 5), (300, 8)])
def test_a_third_copies_beside_small_groups(spark, monkeypatch, block, least):
    monkeypatch.setattr(M, "BLOCK", block)
    rows, groups = planted([100, 80, 60, 40, 25, 12, 8, 5, 300, 200], loose=100, seed=3)
    v = np.random.default_rng(30).normal(size=64)
    copies = [(5000 + i, 1, (v / np.linalg.norm(v)).tolist()) for i in range(500)]
    got = M.groups(spark.createDataFrame(rows + copies, SCHEMA), 64)
    assert [g for g in found(got) if len(g) >= least] == sorted(g for g in [*groups, [r[0] for r in copies]] if len(g) >= least)


@pytest.mark.parametrize("sizes", [[22], [21, 9], [26, 12], [7]])
def test_builds_of_fewer_rows_than_dimensions(spark, sizes):
    rows, groups = planted(sizes, loose=0, seed=11)
    assert found(M.groups(spark.createDataFrame(rows, SCHEMA), 64)) == sorted(groups)
