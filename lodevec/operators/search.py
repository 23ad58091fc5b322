"""Index-backed regex-filtered search: clustered, two-level and graph strategies, and the registry of all of them.

Contracts are those of operators.exact. Every strategy verifies the regular expression itself, so all returned rows
match; the trigram plan only narrows where to look.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators import cluster, exact, gramindex, pq
from lodevec.plans import regexplan
from lodevec.session import small, written


def patterns_of(queries: DataFrame) -> dict[int, str]:
    return {q.qid: q.regex for block in exact.batch(queries) for q in block}


def candidate_clusters(queries: DataFrame, grams: DataFrame, centroids: DataFrame) -> DataFrame:
    """(qid, cluster_id): clusters that may hold a match. An empty gram index constrains nothing."""
    plan = regexplan.dnf_frame(queries.sparkSession, patterns_of(queries))
    if grams.isEmpty():
        plan = plan.select("qid").distinct().select("qid", F.lit(0).alias("conj_id"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("n_grams"))
    return gramindex.candidates(plan, grams, "cluster_id", centroids)


def _scan_codes(queries: list[exact.Query], allowed: list[np.ndarray], books: np.ndarray, ef: int):
    """mapInArrow function over (id, str or mask, cluster_id, code): per task the ef nearest matches of each query by
    ADC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = exact.Matches(queries, False)
        luts = [pq.lookup(np.array(q.vec), books) for q in queries]
        best = [(np.zeros(0), np.zeros(0, "i8")) for _ in queries]
        for b in batches:
            ids, where = b.column("id").to_numpy(), b.column("cluster_id").to_numpy()
            code = b.column("code").flatten().to_numpy().reshape(len(ids), -1)
            hit = patterns.of(b)
            for k, q in enumerate(queries):
                rows = np.flatnonzero(np.isin(where, allowed[k]))
                rows = hit(q.regex, rows) if len(rows) else rows
                if len(rows):
                    d = np.concatenate([best[k][0], pq.adc(code[rows], luts[k])])
                    i = np.concatenate([best[k][1], ids[rows]])
                    cut = exact.smallest(d, i, ef)
                    best[k] = (d[cut], i[cut])
        for q, (d, i) in zip(queries, best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q.qid)), pa.array(i), pa.array(d)], names=["qid", "id", "adc"])

    return run


def index_rows(corpus: DataFrame, membership: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, str, cluster_id, code): what the clustered scan reads. Stored partitioned by cluster (sources.store), a
    search reads the files of its clusters only and joins nothing."""
    return codes.join(membership.select("id", "cluster_id"), "id").join(corpus.select("id", "str"), "id").select("id", "str", "cluster_id", "code")


def ann(corpus: DataFrame, queries: DataFrame, centroids: DataFrame, membership: DataFrame | None, grams: DataFrame, codebook: DataFrame, codes: DataFrame | None, k: int = 10, ef: int = 0, nprobe: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """Candidate clusters by trigrams, the nprobe nearest of them (all where 0), the max(ef, k) matches nearest by ADC,
    reranked by exact distance. Vectors are read only for the pool; the scan takes codes and texts, from rows (of
    index_rows) where given, else joined from membership, codes and corpus."""
    ef = max(ef, k)
    spark = corpus.sparkSession
    chosen = written(cluster.rank_clusters(queries, centroids, nprobe, candidate_clusters(queries, grams, centroids)).select("qid", F.col("cluster_id").alias("cell")), "ann-clusters")
    rows = index_rows(corpus, membership, codes) if rows is None else rows
    pool = spark.createDataFrame([], "qid long, id long, adc double")
    books, most = pq.books(codebook), nprobe or centroids.count()
    for block in exact.batch(queries, 8 * most):
        allowed = exact.cells_of(block, chosen)
        wanted = sorted({int(c) for a in allowed for c in a})
        mine = rows.filter(F.col("cluster_id").isin(wanted)) if len(wanted) <= 1000 else rows.join(F.broadcast(spark.createDataFrame([(c,) for c in wanted], "cluster_id int")), "cluster_id", "left_semi")
        if len({q.regex for q in block}) <= exact.MASK_BITS:
            mine = mine.withColumn("mask", exact.mask_of(block)).filter("mask <> 0").select("id", "mask", "cluster_id", "code")
        else:
            mine = mine.select("id", "str", "cluster_id", "code")
        pool = pool.unionByName(mine.mapInArrow(_scan_codes(block, allowed, books, ef), "qid long, id long, adc double"))
    return _rerank(exact.ranked(pool, ef, "adc").select("qid", "id"), corpus, queries, k)


def _rerank(pool: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """pool: at most ef rows a query."""
    asked = queries.select("qid", "qvec")
    rows = pool.join(corpus.select("id", "vec"), "id").join(small(asked, 1024), "qid")
    return exact.ranked(rows.select("qid", "id", V.l2(F.col("vec"), F.col("qvec")).alias("dist")), k).select("qid", "rank", "id", "dist")


def hier(corpus: DataFrame, queries: DataFrame, coarse: DataFrame, fine: DataFrame, membership: DataFrame, grams: DataFrame, k: int = 10, nprobe: int = 0) -> DataFrame:
    """Two-level routing: the nprobe nearest coarse clusters (half of them where 0), in them the fine clusters that may
    hold a match, in those the exact k nearest matches, by one scan of their rows. grams: (gram, fine_id)."""
    nprobe = nprobe or max(1, coarse.count() // 2)
    near = cluster.rank_clusters(queries, coarse.withColumnRenamed("coarse_id", "cluster_id"), nprobe).select("qid", F.col("cluster_id").alias("coarse_id"))
    plan = regexplan.dnf_frame(corpus.sparkSession, patterns_of(queries))
    may = gramindex.candidates(plan, grams, "fine_id", fine)
    cells = near.join(fine.select("fine_id", "coarse_id"), "coarse_id").join(may, ["qid", "fine_id"], "left_semi")
    cells = written(cells.select("qid", F.col("fine_id").alias("cell")), "hier-cells")
    rows = corpus.drop("cell").join(membership.select("id", F.col("fine_id").alias("cell")), "id")
    return exact.in_cells(rows, queries, cells, fine.count(), k)


def graph(corpus: DataFrame, queries: DataFrame, node_grams: DataFrame, k: int = 10) -> DataFrame:
    """Rows that hold the needed trigrams, verified and ranked exactly. node_grams: (gram, id).

    The plan says which rows any constrained query could match; those are scanned for all of these queries at once, as a
    row that is no candidate of a query cannot match it. Queries without a constraint scan the corpus."""
    patterns = patterns_of(queries)
    free = {q for q, p in patterns.items() if regexplan.required(p) == regexplan.ALL}
    plan = regexplan.dnf_frame(corpus.sparkSession, {q: p for q, p in patterns.items() if q not in free})
    ids = gramindex.candidates(plan, node_grams, "id", corpus.select("id").limit(0)).select("id").distinct()
    names = F.broadcast(corpus.sparkSession.createDataFrame([(q,) for q in free], "qid long"))
    some = exact.groundtruth(corpus.join(ids, "id", "left_semi"), queries.join(names, "qid", "left_anti"), k)
    return some.unionByName(exact.groundtruth(corpus, queries.join(names, "qid", "left_semi"), k)) if free else some


def graph_full(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """graph over an index made here."""
    return graph(corpus, queries, gramindex.gram_index(corpus, "id"), k)


def conjunction(corpus: DataFrame, grams: list[str], node_grams: DataFrame, qvec: list[float], k: int = 10) -> DataFrame:
    """(id, dist): the k nearest rows that hold all of the trigrams, whatever their text else; all rows without any."""
    need = sorted(set(grams))
    held = node_grams.filter(F.col("gram").isin(need)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(need))
    rows = corpus.join(held, "id", "left_semi") if need else corpus
    q = F.array(*[F.lit(float(x)) for x in qvec])
    return rows.filter(V.usable(F.col("vec"), len(qvec))).select("id", V.l2(F.col("vec"), q).alias("dist")).orderBy("dist", "id").limit(k)


#: Up to so many candidates of a query are scanned exactly; of more, so many are entries of its beam.
EXACT_MOST, ENTRIES = 500, 8


def graph_beam(corpus: DataFrame, queries: DataFrame, edges: DataFrame, entries: DataFrame, k: int = 10, ef: int = 64, rounds: int = 6, node_grams: DataFrame | None = None) -> DataFrame:
    """Beam search over a neighbour graph, all queries at once: each round joins the beams with their out-edges and
    keeps the ef nearest visited rows of a query; the last beam is verified. edges: (src, dst); entries: (id);
    node_grams: (gram, id), made from the corpus where not given.

    Only rows that the trigram plan allows are visited. A query with at most EXACT_MOST of them, or whose beam gives
    fewer than k matches, gets all its candidates scanned exactly, so none ends short of matches that exist."""
    spark, patterns = corpus.sparkSession, patterns_of(queries)
    free = {q for q, p in patterns.items() if regexplan.required(p) == regexplan.ALL}
    plan = regexplan.dnf_frame(spark, {q: p for q, p in patterns.items() if q not in free})
    node_grams = gramindex.gram_index(corpus, "id") if node_grams is None else node_grams
    allowed = written(gramindex.candidates(plan, node_grams, "id", corpus.select("id").limit(0)), "beam-candidates")
    large = written(allowed.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") > EXACT_MOST).select("qid"), "beam-large")
    may = allowed.join(small(large, 16), "qid", "left_semi")
    free_q = F.broadcast(spark.createDataFrame([(q,) for q in free], "qid long"))  # part of the query set on the driver
    q = small(written(queries.select("qid", "qvec"), "beam-queries"), 1024)
    nodes, entry = corpus.select("id", "vec"), small(entries.select("id").distinct(), 16)

    def near(pairs: DataFrame) -> DataFrame:
        d = pairs.distinct().join(nodes, "id").join(q, "qid").filter(V.usable(F.col("vec"), F.size("qvec")))
        return exact.ranked(d.select("qid", "id", V.l2(F.col("vec"), F.col("qvec")).alias("dist")), ef).select("qid", "id")

    first = exact.ranked(may.select("qid", "id", F.xxhash64("qid", "id").cast("double").alias("dist")), ENTRIES).select("qid", "id")
    beam = near(first.unionByName(may.join(entry, "id", "left_semi").select("qid", "id")).unionByName(entries.select("id").distinct().join(free_q).select("qid", "id")))
    for _ in range(rounds):
        step = beam.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id")).distinct()
        beam = near(beam.unionByName(step.join(may, ["qid", "id"], "left_semi")).unionByName(step.join(free_q, "qid", "left_semi")))
    found = written(_verified(beam, corpus, queries, patterns, k), "beam-found")
    enough = small(written(found.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("qid"), "beam-enough"), 16)
    exact_ = graph(corpus, queries.join(enough, "qid", "left_anti"), node_grams, k)
    return found.join(enough, "qid", "left_semi").select("qid", "rank", "id", "dist").unionByName(exact_)


def _verified(pairs: DataFrame, corpus: DataFrame, queries: DataFrame, patterns: dict[int, str], k: int) -> DataFrame:
    """The k nearest of beams (qid, id) that match. Rows of a query stand together, so its pattern is compiled once."""
    java = corpus.sparkSession.createDataFrame([(q, regexplan.to_java(p)) for q, p in patterns.items()], "qid long, java string")
    asked = small(queries.select("qid", "qvec").join(F.broadcast(java), "qid"), 1024)
    rows = pairs.join(corpus.select("id", "str", "vec"), "id").join(asked, "qid").repartition("qid").sortWithinPartitions("qid")
    hits = rows.filter(F.expr("str rlike java")).select("qid", "id", V.l2(F.col("vec"), F.col("qvec")).alias("dist"))
    return exact.ranked(hits, k).select("qid", "rank", "id", "dist")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "groundtruth": exact.groundtruth, "baseline": exact.groundtruth, "prefilter": exact.prefilter,
    "postfilter": exact.postfilter, "ann": ann, "hier": hier, "graph": graph, "graph_beam": graph_beam,
}
OPTIONS = {
    "groundtruth": set(), "baseline": set(), "prefilter": {"sample_ratio", "seed"}, "postfilter": {"oversample", "max_expansion"},
    "ann": {"ef", "nprobe"}, "hier": {"nprobe"}, "graph": set(), "graph_beam": {"ef", "rounds"},
}


def parse_options(algorithm: str, words: list[str]) -> dict[str, float | int]:
    """key=value words of a command line. Unknown or irrelevant keys are warned of and dropped; a bare integer is
    oversample for postfilter."""
    if algorithm not in STRATEGIES:
        raise ValueError(f"unknown algorithm {algorithm}; one of {sorted(STRATEGIES)}")
    got: dict[str, float | int] = {}
    for w in words:
        key, eq, value = w.partition("=")
        if not eq and algorithm == "postfilter" and w.isdigit():
            key, value = "oversample", w
        if key not in OPTIONS[algorithm]:
            warnings.warn(f"{algorithm} takes no {key!r}", stacklevel=2)
            continue
        got[key] = float(value) if key == "sample_ratio" else int(value)
    return got


def search(algorithm: str, corpus: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    if algorithm not in STRATEGIES:
        raise ValueError(f"unknown algorithm {algorithm}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[algorithm](corpus, queries, k=k, **options)
