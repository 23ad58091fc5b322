import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodevec.llm import nearsketch as S

SCHEMA = "id long, build_id int, text string, embedding array<float>"


def grams(t):
    p = re.sub(r"\s", " ", re.sub(r"[^A-Za-z\s]", "", t)).lower()
    return frozenset(p[i : i + 3] for i in range(len(p) - 2))


def brute(rows, dim):
    out = set()
    for i, (a, ba, ta, va) in enumerate(rows):
        for b, bb, tb, vb in rows[i + 1 :]:
            if ba is None or ba != bb:
                continue
            near = False
            if ta is not None and tb is not None:
                x, y = grams(ta), grams(tb)
                near = min(len(x), len(y)) >= 12 and len(x & y) * 5 >= 3 * len(x | y)
            if not near and va is not None and vb is not None and len(va) == len(vb) == dim and any(va) and any(vb):
                near = np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98
            if near:
                out.add((min(a, b), max(a, b)))
    return out


def rows_with_edits(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(300)]
    rows, i = [], 0
    for _ in range(n):
        t, v = " ".join(rng.choices(words, k=9)), [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(rng.choice([1, 2, 3])):
            u = t.split()
            if rng.random() < 0.5:
                u[rng.randrange(9)] = rng.choice(words)
            rows.append((i, rng.choice([1, 1, 2]), " ".join(u).upper() if rng.random() < 0.3 else " ".join(u), [x + rng.gauss(0, 0.02) for x in v]))
            i += 1
    rows += [(i + k, 1, "copied text about a very common thing", [0.0] * 16) for k in range(12)]
    rows += [(i + 20, 1, None, None), (i + 21, 1, "", [1.0]), (i + 22, 1, "short", None), (i + 23, None, "copied text about a very common thing", None), (i + 24, 1, "untitled", None), (i + 25, 1, "untitled", None)]
    return rows


@pytest.mark.parametrize("run_most", [4096, 3])
def test_pairs_equal_brute_force(spark, monkeypatch, run_most):
    monkeypatch.setattr(S, "RUN_MOST", run_most)
    rows = rows_with_edits()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as a", "3 as h")
    got = {tuple(r) for r in S.near_pairs(df, 16).collect()}
    want = brute(rows, 16)
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_groups(spark):
    rows = rows_with_edits(3, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = [tuple(r) for r in S.near_pairs(df, 16).collect()]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    assert {r.id: r.group_id for r in S.near_groups(df, 16).collect()} == {x: root(x) for x in list(label)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.near_pairs(df, 16).count() == 0
    assert S.near_groups(df, 16).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.choice(5000, 300, replace=False)
    for j in (0.2, 0.6, 0.9):
        keep = int(round(2 * 300 * j / (1 + j)))
        b = np.concatenate([a[:keep], 5000 + np.arange(300 - keep)])
        row = np.repeat([0, 1], 300)
        s = S.sketch(row, np.concatenate([np.sort(a), np.sort(b)]), 2, 6000, 512)
        assert abs((s[0] == s[1]).mean() - j) < 0.1
    one = S.sketch(np.array([0]), np.array([7]), 1, 10, 64)
    assert (one != 0xFFFFFFFF).all()


def test_gram_codes():
    row, code = S.gram_codes(pa.array(["abab", "", "ab", "a b", "zzzz"]))
    assert row.tolist() == [0, 0, 3, 4]
    assert len(set(code.tolist())) == 4


def test_pairs_at_the_thresholds_are_found(spark):
    rng, rows, want = random.Random(4), [], set()
    while len(want) < 1500:
        head, a, b = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (44, 14, 14))
        x, y = grams(head + a), grams(head + b)
        if len(x & y) * 5 == len(x | y) * 3:
            i = len(rows)
            rows += [(i, 1, head + a, None), (i + 1, 1, head + b, None)]
            want.add((i, i + 1))
    r = np.random.default_rng(4)
    for _ in range(1500):
        u, v = r.normal(size=(2, 16))
        u /= np.linalg.norm(u)
        v -= (u @ v) * u
        i, c = len(rows), 0.98001
        rows += [(i, 1, None, u.tolist()), (i + 1, 1, None, (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)).tolist())]
        want.add((i, i + 1))
    got = {tuple(p) for p in S.near_pairs(spark.createDataFrame(rows, SCHEMA), 16).collect()}
    lost = sorted(want - got)
    assert sum(a < 3000 for a, _ in lost) <= 5 and sum(a >= 3000 for a, _ in lost) <= 5, len(lost)
