import random
from collections import defaultdict

import numpy as np

from lodevec.llm import termfreq as T


def test_frequencies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(T, "FLUSH_ROWS", 700)
    rows = [(rng.randint(1, 2), rng.choice(["hot"] * 10 + [f"t{i}" for i in range(30)] + [None]), rng.choice([rng.randint(0, 300), rng.randint(0, 1 << 20), -5])) for _ in range(6000)]
    rows += [(None, "x", 1), (1, "x", None)] + [(3, "big", i) for i in range(9000)]
    occ, ids, everyone = defaultdict(int), defaultdict(set), defaultdict(set)
    for b, t, i in rows:
        if b is None or i is None:
            continue
        everyone[b].add(i)
        if t is not None:
            occ[b, t] += 1
            ids[b, t].add(i)
    got = T.frequencies(spark.createDataFrame(rows, "build_id int, term string, id long").selectExpr("*", "0 as items", "1 as chunk").repartition(5)).collect()
    named = {(r.build_id, r.term): (r.occurrences, r["items"]) for r in got if r.term is not None}
    assert named == {k: (occ[k], len(ids[k])) for k in occ}
    assert {r.build_id: r["items"] for r in got if r.term is None} == {b: len(v) for b, v in everyone.items()}


def test_empty(spark):
    assert T.frequencies(spark.createDataFrame([], "build_id int, term string, id long")).count() == 0


def test_containers_round_trip():
    for n in (0, 1, 4095, 4096, 65_536):
        low = np.sort(np.random.default_rng(1).choice(65_536, n, replace=False))
        assert (T.unpack(T.pack(low)) == low).all()


def test_words_and_marks(spark):
    items = spark.createDataFrame([(1, 1, "The the AB-cde f9gh"), (2, 1, ""), (3, 1, None), (4, 1, "x" * 100_000), (5, 1, "the")], "id long, build_id int, text string")
    got = {r.term: (r["items"], r.occurrences, r.mark) for r in T.marked(T.frequencies(T.words(items)), 1, 2).collect()}
    assert got == {"the": (2, 3, "common"), "cde": (1, 1, "rare"), "x" * 100_000: (1, 1, "rare")}
