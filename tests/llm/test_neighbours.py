import numpy as np

from lodevec.llm import multihash as H

SCHEMA = "id long, build_id int, vec array<float>"


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        d = np.square(x.astype("f8") - x[i].astype("f8")).sum(1)
        order = np.lexsort((ids, d))
        out[int(ids[i])] = [int(ids[j]) for j in order if j != i][:k]
    return out


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, dim))
    p = np.array([0.35, *[0.65 / 11] * 11])
    return (c[rng.choice(12, n, p=p)] + rng.normal(size=(n, dim)) * 0.25).astype("f4")


def run(spark, rows, dim, k=5):
    return {r.id: [n.o for n in r.near] for r in H.neighbours(spark.createDataFrame(rows, SCHEMA), dim, k).collect()}


def recall(got, want):
    return sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))


def test_small_builds_use_the_index_too(spark):
    x = clustered(300)
    rows = [(i, i % 2, x[i].tolist()) for i in range(300)]
    got, wide = run(spark, rows, 16), {r.id: [n.o for n in r.near] for r in H.neighbours(spark.createDataFrame(rows, SCHEMA), 16, 5, flips=1).collect()}
    for b in (0, 1):
        ids = np.arange(b, 300, 2)
        want = brute(ids, x[ids], 5)
        assert recall(got, want) > 0.9 and recall(wide, want) > 0.99


def test_distances_are_those_of_the_stored_vectors(spark):
    x = clustered(400, seed=9)
    for r in H.neighbours(spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], SCHEMA), 16).collect():
        d = [np.square(x[r.id].astype("f8") - x[n.o].astype("f8")).sum() for n in r.near]
        assert np.allclose(d, [n.d for n in r.near], rtol=1e-12) and np.all(np.diff([n.d for n in r.near]) >= 0)


def test_rounding_never_decides(spark):
    """Distances that differ by less than the rounding of the vectors that travel."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8)).astype("f4")
    x = np.concatenate([base + rng.normal(size=base.shape).astype("f4") * np.float32(1e-5) for _ in range(12)])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    want = brute(np.arange(len(x)), x, 5)
    assert {tuple(p) for p in H.near_pairs(df, 8).collect()} == {(min(i, j), max(i, j)) for i, v in want.items() for j in v}


def test_bits_keep_buckets_bounded():
    bits = [H.substring_bits(n) for n in (1, 2, 450, 45_000, 4_500_000, 450_000_000)]
    assert bits == sorted(bits) and bits[0] == 1 and all(n >> b <= H.BUCKET_ROWS for n, b in zip((4_500_000, 450_000_000), bits[4:]))


def test_recall_with_indexes(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 150)
    x = clustered(3000)
    got = run(spark, [(i, 1, v.tolist()) for i, v in enumerate(x)], 16)
    want = brute(np.arange(3000), x, 5)
    assert set(got) == set(want)
    assert all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / 15_000 > 0.9


def test_ties_and_equal_vectors(spark, monkeypatch):
    rows = [(i, 1, [1.0, 2.0]) for i in range(20)] + [(100, 1, [1.0, 3.0]), (101, 1, [2.0, 2.0])]
    got = run(spark, rows, 2)
    assert got[15] == [0, 1, 2, 3, 4] and got[2] == [0, 1, 3, 4, 5] and got[100] == [0, 1, 2, 3, 4]
    assert set(got) == {*range(20), 100, 101}


def test_unusable_rows_and_lone_rows(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, None), (3, 1, [0.0, 0.0]), (4, 1, [1.0]), (5, 1, [float("nan"), 1.0]), (6, 2, [1.0, 1.0]), (7, 1, [2.0, 0.0]), (8, None, [2.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as near", "2 as d")
    assert {r.id: [n.o for n in r.near] for r in H.neighbours(df, 2).collect()} == {1: [7], 7: [1]}
    assert [tuple(r) for r in H.near_pairs(df, 2).collect()] == [(1, 7)]
    assert H.near_pairs(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_scan_for_rows_with_empty_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "substring_bits", lambda n: 12)
    x = clustered(400, seed=5)
    got = run(spark, [(i, 1, v.tolist()) for i, v in enumerate(x)], 16)
    assert len(got) == 400 and all(len(v) == 5 for v in got.values())


def test_shrinking_keeps_sixteen_bits():
    x = np.random.default_rng(1).normal(size=(50, 7)).astype("f4")
    y = H.restore(H.shrink(x))
    assert np.abs(y - x).max() <= np.abs(x).max() * 2**-16
    z = np.arange(256, dtype="f4").reshape(8, 32)
    assert (H.restore(H.shrink(z)) == z).all()


def test_nearest_is_exact_with_groups_of_columns():
    x = np.random.default_rng(2).normal(size=(900, 6)).astype("f4")
    row, near, _ = H.nearest(x, np.arange(900), x, np.arange(900), 5)
    want = brute(np.arange(900), x, 5)
    assert all(list(near[row == i]) == want[i] for i in range(900))
