import math
import random

import pytest
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.functions import vector as V
from lodevec.operators import cluster, evaluate, exact, gramindex, graph, pq, search, workload
from lodevec.plans import regexplan

ROWS = [
    (0, "deep learning for image retrieval", [0.0, 0.0]), (1, "approximate nearest neighbor search", [1.0, 0.0]), (2, "graph neural network embedding", [0.0, 2.0]),
    (3, "Deep graph network", [3.0, 0.0]), (4, "search engines", [1.0, 0.0]), (5, "deep sea fishing", [5.0, 0.0]),
]
CORPUS = "id long, str string, vec array<float>"
QUERY = "qid long, regex string, qvec array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    shifted = [(i, s, [v[0] + 1, v[1] + 1]) for i, s, v in ROWS]
    dirty = [(6, None, [0.5, 0.5]), (7, "deep", None), (8, "deep", [float("nan"), 1.0]), (9, "deep", [1.0]), (10, "deep", [0.0, 0.0]), (11, "", [9.0, 9.0])]
    return spark.createDataFrame(shifted + dirty, CORPUS).withColumn("dist", F.lit("clash")).withColumn("rank", F.lit(1))


def ask(spark, *regexes):
    return spark.createDataFrame([(i, r, [1.0, 1.0]) for i, r in enumerate(regexes)], QUERY)


def ids(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_groundtruth(spark, corpus):
    got = ids(exact.groundtruth(corpus, ask(spark, "^deep", "search", "graph|network", "zebra", "(", None), 2))
    assert got == {0: [0, 3], 1: [1, 4], 2: [2, 3]}


def test_postfilter_cap(spark, corpus):
    q = ask(spark, "^deep")
    assert ids(exact.postfilter(corpus, q, 2, max_expansion=1)) == {0: [0]}
    assert ids(exact.postfilter(corpus, q, 2, max_expansion=2)) == {0: [0]}
    assert ids(exact.postfilter(corpus, q, 2)) == {0: [0, 3]}
    with pytest.raises(ValueError):
        exact.postfilter(corpus, q, 2, oversample=0)


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], CORPUS)
    assert exact.groundtruth(none, ask(spark, "a"), 2).count() == 0
    assert exact.groundtruth(corpus, spark.createDataFrame([], QUERY), 2).count() == 0
    assert exact.prefilter(none, ask(spark, "a"), 2, 0.5).count() == 0


def test_topk_and_metrics(spark, corpus):
    assert [r.id for r in exact.topk(corpus, "deep", [1.0, 1.0], 2).collect()] == [0, 3]
    assert exact.topk(corpus, "(", [1.0, 1.0]).count() == 0
    got = exact.groundtruth(corpus, ask(spark, "deep"), 1, "ip").first()
    assert (got.id, got.dist) == (5, -7.0)


def test_builds_stay_apart(spark, corpus):
    c = corpus.withColumn("build_id", (F.col("id") % 2).cast("int"))
    q = ask(spark, "^deep").withColumn("build_id", F.lit(1))
    assert ids(exact.groundtruth(c, q, 3)) == {0: [3, 5]}


def random_corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = ["deep", "graph", "vector", "search", "red", "blue", "index", "a-b", "x9"]
    rows = [(i, " ".join(rng.choices(words, k=4)), [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    return spark.createDataFrame(rows, CORPUS), spark.createDataFrame([(i, r, rows[i][2]) for i, r in enumerate(["deep.*search", "graph|vector", "a-b", "^red", "blue$", "x9 x9", "zz"])], QUERY)


def test_prefilter_sample_is_exact_in_size(spark):
    c, q = random_corpus(spark)
    matches = exact.match_counts(c, {r.qid: r.regex for r in q.collect()})
    got = exact.prefilter(c, q, 1000, 0.3).groupBy("qid").count()
    for r in matches.join(got, "qid", "left").fillna(0).collect():
        assert r["count"] == r.matches  # k is above all matches
    got = exact.prefilter(c, q, 5, 0.5)
    assert got.join(exact.groundtruth(c, q, 10_000).select("qid", "id"), ["qid", "id"], "left_anti").count() == 0
    assert got.groupBy("qid").count().filter("count != 5").join(matches, "qid").filter("matches >= 5").count() == 0


def test_index_strategies_equal_groundtruth(spark):
    c, q = random_corpus(spark)
    want = ids(exact.groundtruth(c, q, 10))
    cent = cluster.kmeans(c, 6, 5)
    member = cluster.assign(c, cent).select("id", "cluster_id").cache()
    grams = gramindex.gram_index(c.join(member, "id"), "cluster_id")
    book = pq.train(c, 8, 4, 16, 5).cache()
    assert ids(search.ann(c, q, cent, member, grams, book, pq.encode(c, book), 10, ef=10_000)) == want
    assert ids(search.graph(c, q, gramindex.gram_index(c, "id"), 10)) == want
    coarse, fine, fm = cluster.hierarchical(c, 3, 3, 5)
    fg = gramindex.gram_index(c.join(fm.select("id", "fine_id"), "id"), "fine_id")
    assert ids(search.hier(c, q, coarse, fine, fm.select("id", "fine_id"), fg, 10, nprobe=3)) == want
    some = search.ann(c, q, cent, member, grams, book, pq.encode(c, book), 10, ef=20, nprobe=2)
    assert some.join(exact.groundtruth(c, q, 10_000).select("qid", "id"), ["qid", "id"], "left_anti").count() == 0
    edges = graph.symmetric(graph.knn_edges(c.withColumn("build_id", F.lit(0)), 8, 8), 16)
    beam = search.graph_beam(c, q, edges, workload.sample(c, 4), 10, 300, 4)
    assert evaluate.summary(evaluate.recall(q, exact.groundtruth(c, q, 10), beam)).first().mean_recall > 0.9


def test_beam_gives_rare_matches(spark):
    rng = random.Random(6)
    rows = [(i, "common text" + (" zebra" if i % 60 == 59 else " 7" if i % 60 == 29 else ""), [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(720)]
    c = spark.createDataFrame(rows, CORPUS)
    q = spark.createDataFrame([(0, "zebra", [3.0, 3.0]), (1, "common.* 7", [3.0, 3.0]), (2, "nowhere", [0.0, 0.0])], QUERY)
    edges = graph.symmetric(graph.knn_edges(c.withColumn("build_id", F.lit(0)), 2, 8), 16)
    got = ids(search.graph_beam(c, q, edges, workload.sample(c, 4), 10, 16, 2))
    assert got == ids(exact.groundtruth(c, q, 10)) and len(got[0]) == len(got[1]) == 10


def test_candidates_hold_every_match(spark):
    c, q = random_corpus(spark)
    plan = regexplan.dnf_frame(spark, search.patterns_of(q))
    may = gramindex.candidates(plan, gramindex.gram_index(c, "id"), "id", c)
    assert exact.groundtruth(c, q, 10_000).join(may, ["qid", "id"], "left_anti").count() == 0


def test_recall(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "qid long")
    gt = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 4), (3, 1, 7), (4, 1, 5)], "qid long, rank long, id long")
    pred = spark.createDataFrame([(0, 3), (0, 2), (0, 9), (1, 1), (2, 1), (2, 4), (3, 7), (3, 8), (4, 5), (4, 5)], "qid long, id long")
    got = {r.qid: r.recall for r in evaluate.recall(q, gt, pred, 3).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: 1.0, 2: pytest.approx(1 / 3), 3: 1.0, 4: 1.0}
    assert {r.qid: r.recall for r in evaluate.recall(q, gt, pred, 3, "k").collect()}[1] == 0
    assert evaluate.summary(evaluate.recall(q, gt, pred, 3)).first().perfect == 3


def test_kmeans_step_and_ties(spark):
    c = spark.createDataFrame([(0, [0.5]), (1, [1.0]), (2, [10.0]), (3, [11.0]), (4, [5.0])], "id long, vec array<float>")
    cent = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "cluster_id int, centroid array<double>")
    m = cluster.assign(c, cent)
    assert {r.id: r.cluster_id for r in m.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}
    assert {r.cluster_id: r.centroid[0] for r in cluster.update(c, m).collect()} == {0: pytest.approx(6.5 / 3), 1: 10.5}


def test_quantisation(spark):
    import numpy as np

    b = np.array([[[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [2.0, 2.0]]])
    lut = pq.lookup(np.zeros(4), b)
    assert lut.tolist() == [[0, 2], [0, 8]]
    assert pq.adc(np.array([[1, 0], [1, 1]]), lut).tolist() == [2, 10]
    assert [pq.fitting_m(d, 8) for d in (64, 10, 7, 11)] == [8, 5, 7, 1]
    book = spark.createDataFrame([(s, k, b[s][k].tolist()) for s in (0, 1) for k in (0, 1)], pq.CODEBOOK)
    rows = spark.createDataFrame([(0, [1.0, 1.0, 0.0, 0.0]), (1, [0.9, 0.9, 1.9, 2.0]), (2, None)], "id long, vec array<float>")
    assert {r.id: list(r.code) for r in pq.encode(rows, book).collect()} == {0: [1, 0], 1: [1, 1]}
    with pytest.raises(ValueError):
        pq.train(rows, 4, 2, 257)


def test_texts(spark):
    df = spark.createDataFrame([("Ab-1\tC",), (None,), ("  A-b  1c ",), ("The AI of 3D maps",), ("ab",), ("Kelvin",)], "s string")
    pre = [r[0] for r in df.select(T.preprocess(F.col("s"))).collect()]
    assert pre == ["ab c", None, "  ab  c ", "the ai of d maps", "ab", "elvin"]
    assert [r[0] for r in df.select(T.preprocess_letters(F.col("s"))).collect()][0] == "abc"
    assert [r[0] for r in df.select(T.clean_text(F.col("s"))).collect()][1:3] == ["", "A b c"]
    assert [r[0] for r in df.select(T.extract_words(F.col("s"))).collect()][3] == ["the", "maps"]
    assert [r[0] for r in df.select(T.trigrams(F.lit("ab cd"))).collect()][0] == ["ab ", "b c", " cd"]
    assert [r[0] for r in df.select(T.trigrams(F.col("s"))).collect()][4] == []
    line = spark.createDataFrame([("<title>A &amp; B</title><title>x</title>",), (None,)], "s string")
    assert [r[0] for r in line.select(T.clean_text(T.unescape_html(T.title_of(F.col("s"))))).collect()] == ["A B", ""]
    long = spark.createDataFrame([("x" * 200_000,)], "s string")
    assert long.select(F.size(T.trigrams(T.preprocess(F.col("s"))))).first()[0] == 199_998


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.l2(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("a")), V.format_vector(F.col("a"))).first()
    assert r[0] == 5 and r[1] is None and math.isclose(r[2], 0, abs_tol=1e-12) and r[3] == "3.000000 4.000000"
    bad = spark.createDataFrame([(None,), ([1.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([None, 1.0],), ([0.0, 1.0],)], "v array<float>")
    assert [x[0] for x in bad.select(V.usable(F.col("v"), 2)).collect()] == [False] * 5 + [True]


def test_options():
    with pytest.warns(UserWarning):
        assert search.parse_options("ann", ["ef=20", "nprobe=3", "sample_ratio=1"]) == {"ef": 20, "nprobe": 3}
    assert search.parse_options("postfilter", ["7"]) == {"oversample": 7}
    with pytest.raises(ValueError):
        search.search("nosuch", None, None)


def test_selectivity_band_needs_room(spark):
    with pytest.raises(ValueError):
        workload.with_selectivity(None, None, 100, 0.5, 0.05, 10)


def test_neighbour_graph_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 10)
    rows = [(i, 0, [1.0, 1.0]) for i in range(30)] + [(50, 0, [1.0, 2.0]), (51, 1, [1.0, 2.0]), (52, 0, None), (None, 0, [1.0, 1.0]), (53, None, [1.0, 1.0]), (54, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, build_id int, vec array<float>").withColumn("dist", F.lit(1))
    got = {}
    for r in graph.knn_edges(df, 2, 3).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert set(got) == {*range(30), 50} and got[0] == [1, 2, 3] and got[7] == [0, 1, 2] and got[50] == [0, 1, 2]
    assert graph.shared_grams(graph.knn_edges(df, 2, 3).limit(0), df.withColumn("str", F.lit("x"))).count() == 0


def test_null_ids_and_empty_codebooks(spark):
    c = spark.createDataFrame([(None, "red", [1.0]), (1, "red", [2.0])], CORPUS)
    q = spark.createDataFrame([(None, "red", [1.0]), (5, "red", [1.0])], QUERY)
    assert ids(exact.groundtruth(c, q, 3)) == {5: [1]}
    cent = spark.createDataFrame([(0, [0.0])], "cluster_id int, centroid array<double>")
    assert [r.id for r in cluster.assign(c, cent).collect()] == [1]
    none = pq.train(c.limit(0), 1, 1, 4)
    assert pq.encode(c, none).count() == 0
    assert cluster.kmeans(c.limit(0), 3).count() == 0 and cluster.assign(c, cluster.kmeans(c.limit(0), 3)).count() == 0


def test_many_patterns_count_the_same(spark):
    c, _ = random_corpus(spark)
    few = {i: p for i, p in enumerate(["deep", "^red", "x9$", "(", "zz"])}
    many = {i: few[i % 5] for i in range(60)}
    want = {r.qid: r.matches for r in exact.match_counts(c, few).collect()}
    got = {r.qid: r.matches for r in exact.match_counts(c, many).collect()}
    assert got == {i: want[i % 5] for i in range(60) if i % 5 in want}


def test_matches_come_from_either_engine(spark, monkeypatch):
    c, q = random_corpus(spark)
    want = ids(exact.groundtruth(c, q, 10))
    monkeypatch.setattr(exact, "MASK_BITS", 2)
    assert ids(exact.groundtruth(c, q, 10)) == want
    assert ids(exact.postfilter(c, q, 10)) == want


def test_queries_come_in_blocks(spark, monkeypatch):
    c, q = random_corpus(spark)
    want = ids(exact.groundtruth(c, q, 10))
    monkeypatch.setattr(exact, "BROADCAST_LIMIT", 200)
    assert len(list(exact.batch(q))) > 2
    assert ids(exact.groundtruth(c, q, 10)) == want


def test_cells_limit_what_a_query_sees(spark):
    c, q = random_corpus(spark)
    c = c.withColumn("cell", (F.col("id") % 5).cast("int"))
    cells = spark.createDataFrame([(i, x) for i in range(7) for x in ([i % 5, 4] if i else [])], "qid long, cell int")
    got = ids(exact.in_cells(c, q, cells, 2, 10))
    for i, r in enumerate(q.orderBy("qid").collect()):
        some = c.filter(F.col("cell").isin([i % 5, 4] if i else []))
        assert got.get(i, []) == ids(exact.groundtruth(some, q.filter(F.col("qid") == i), 10)).get(i, [])


def test_unconstrained_queries_see_all(spark):
    c, _ = random_corpus(spark)
    q = spark.createDataFrame([(0, "[a-z]", [0.1] * 8), (1, "deep", [0.1] * 8), (2, "a.", [0.2] * 8)], QUERY)
    want = ids(exact.groundtruth(c, q, 10))
    assert ids(search.graph_full(c, q, 10)) == want
    edges = graph.symmetric(graph.knn_edges(c.withColumn("build_id", F.lit(0)), 8, 8), 16)
    beam = search.graph_beam(c, q, edges, workload.sample(c, 4), 10, 300, 4)
    assert evaluate.summary(evaluate.recall(q, exact.groundtruth(c, q, 10), beam)).first().mean_recall > 0.9


def test_conjunction(spark, corpus):
    grams = gramindex.gram_index(corpus, "id")
    assert [r.id for r in search.conjunction(corpus, ["dee", "gra"], grams, [1.0, 1.0], 3).collect()] == [3]
    assert search.conjunction(corpus, [], grams, [1.0, 1.0], 100).count() == 8


def test_cluster_means_with_zero_rows(spark):
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 4.0]), (2, None), (3, [1.0, 1.0])], "id long, vec array<float>")
    m = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (3, None)], "id long, cluster_id int")
    assert [(r.cluster_id, list(r.centroid)) for r in cluster.update(c, m).collect()] == [(7, [1.0, 2.0])]


def test_listing_in_lines(spark):
    from lodevec.sources import store

    m = spark.createDataFrame([(i, 1) for i in range(25)] + [(3, 1), (None, 1), (5, None)], "id long, cluster_id int")
    got = {r.part: (r.members, r.ids) for r in store.listing(m, 10).collect()}
    assert got == {0: (10, " ".join(map(str, range(10)))), 1: (10, " ".join(map(str, range(10, 20)))), 2: (5, "20 21 22 23 24")}


def test_cell_edges(spark):
    rng = random.Random(4)
    rows = [(i, 0, [rng.gauss(c, 0.1), rng.gauss(-c, 0.1)]) for c in (0, 5, 10) for i in range(c * 100, c * 100 + 40)]
    df = spark.createDataFrame(rows, "id long, build_id int, vec array<float>")
    cent = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, -5.0]), (2, [10.0, -10.0])], "cluster_id int, centroid array<double>")
    key = lambda d: sorted((r.src, r.rank, r.dst) for r in d.collect())
    assert key(graph.cell_edges(df, cent, 2, 3, 1)) == key(graph.knn_edges(df, 2, 3))
