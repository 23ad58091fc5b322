import random
from collections import Counter, defaultdict

from lodevec.operators import heavykeys as H


def brute(rows):
    by = defaultdict(list)
    for b, k, i in rows:
        if k is not None:
            by[b, k].append(i)
    out = {}
    for key, ids in by.items():
        c = Counter(i for i in ids if i is not None)
        top = min(c, key=lambda i: (-c[i], i)) if c else None
        out[key] = (len(ids), len(c), top, c[top] if c else None)
    return out


def test_per_key_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", rng.choice([None, *range(60)])) for _ in range(4000)]
    rows += [(1, None, 5)] * 50 + [(1, "nulls", None)] * 3
    df = spark.createDataFrame(rows, "build_id int, gram string, id long").selectExpr("*", "'x' as rows", "0 as node")
    want = brute(rows)
    for fan_in in (2, 8):
        got = {(r.build_id, r.key_value): (r.rows, r.ids, r.top_id, r.top_rows) for r in H.per_key(H.keyed(df, ["build_id"], ["gram"], "id"), ["build_id"], fan_in).collect()}
        assert got == want


def test_counts_by_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 2]), 7) for _ in range(3000)]
    df = spark.createDataFrame(rows, "build_id int, gram string, cluster int, id long").repartition(3)
    want = Counter((b, "gram", g) for b, g, _, _ in rows if g is not None) + Counter((b, "cluster", str(c)) for b, _, c, _ in rows if c is not None)
    for chunk in (50, 10**9):
        got = H.counts(df, ["build_id"], ["gram", "cluster"], "id", chunk, 2).collect()
        assert {(r.build_id, r.key_name, r.key_value): r.rows for r in got} == want


def test_heavy_share_is_exact(spark):
    rows = [(1, "a", 1)] * 10 + [(1, f"k{i}", i) for i in range(190)] + [(1, "b", 2)] * 1 + [(2, None, 1)]
    df = spark.createDataFrame(rows, "build_id int, gram string, id long").selectExpr("*", "1 as total", "2 as node")
    assert H.heavy(df, ["build_id"], {"gram": 20}, "id").collect() == []
    assert [(r.key_value, r.rows, r.top_id, r.total) for r in H.heavy(df, ["build_id"], {"gram": 21}, "id").collect()] == [("a", 10, 1, 201)]


def test_empty_and_tree_height(spark):
    df = spark.createDataFrame([], "build_id int, gram string, id long")
    assert H.per_key(H.keyed(df, ["build_id"], ["gram"], "id"), ["build_id"]).count() == 0
    assert H.heavy(df, ["build_id"], {"gram": 10}, "id").count() == 0
    assert [H.levels(n, 8) for n in (0, 1, 8, 9, 64, 65)] == [1, 1, 1, 2, 2, 3]
