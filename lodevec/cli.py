"""Command lines: search over files, and recall of a result against a ground truth.

    python -m lodevec.cli search ALGORITHM K QUERIES VECTORS FORMAT STRINGS OUT [gt=PATH] [key=value ...]
    python -m lodevec.cli recall --gt PATH --pred PATH [--K 10] [--verbose]

Queries, strings, vectors and results have the forms of sources.textio and sources.binary; OUT is a folder that gets the
results as text, a line a query in order, and as a table. Strategies that need an index build it: k-means with
clusters=N, codes with pq_m=N and pq_ksub=N, two levels with the square root of clusters on each, a graph of m=N edges.
"""

from __future__ import annotations

import argparse
import math
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators import cluster, evaluate, exact, gramindex, graph, pq, search, workload
from lodevec.session import written
from lodevec.sources import binary, textio

#: Options that say how an index is built, and their defaults.
BUILD = {"clusters": 16, "pq_m": 8, "pq_ksub": 256, "max_iter": 30, "m": 16}


def corpus_of(spark: SparkSession, vectors: str, fmt: str, strings: str) -> DataFrame:
    """Vectors and strings joined by position. Warns where their numbers differ; what has no partner is left out."""
    v, s = binary.read_vectors(spark, vectors, fmt), textio.load_strings(spark, strings)
    n, m = binary.count_vectors(vectors, fmt)[0], s.count()
    if n != m:
        warnings.warn(f"{n} vectors and {m} strings", stacklevel=2)
    return written(v.join(s, "id"), "corpus")


def run(algorithm: str, corpus: DataFrame, queries: DataFrame, k: int, build: dict[str, int], options: dict) -> DataFrame:
    """The result of a strategy over an index built here."""
    if algorithm not in ("ann", "hier", "graph", "graph_beam"):
        return search.search(algorithm, corpus, queries, k, **options)
    if algorithm == "graph":
        return search.graph_full(corpus, queries, k)
    if algorithm == "graph_beam":
        dim = textio.dimensions(queries)
        edges = written(graph.symmetric(graph.knn_edges(corpus.withColumn("build_id", F.lit(0)), dim, build["m"]), 2 * build["m"]), "edges")
        return search.graph_beam(corpus, queries, edges, workload.sample(corpus, 8), k, **options)
    if algorithm == "hier":
        k0 = max(2, math.isqrt(build["clusters"]))
        coarse, fine, member = cluster.hierarchical(corpus, k0, max(1, build["clusters"] // k0), build["max_iter"])
        member = written(member.select("id", "fine_id"), "fine-membership")
        return search.hier(corpus, queries, coarse, fine, member, gramindex.gram_index(corpus.join(member, "id"), "fine_id"), k, **options)
    c = written(cluster.kmeans(corpus, build["clusters"], build["max_iter"]), "centroids")
    member = written(cluster.assign(corpus, c).select("id", "cluster_id"), "membership")
    dim = textio.dimensions(queries)
    rows = corpus.filter(V.usable(F.col("vec"), dim)).count()
    book = written(pq.train(corpus, dim, pq.fitting_m(dim, build["pq_m"]), max(1, min(build["pq_ksub"], rows))), "codebook")
    grams = gramindex.gram_index(corpus.join(member, "id"), "cluster_id")
    return search.ann(corpus, queries, c, member, grams, book, pq.encode(corpus, book), k, **options)


def results(spark: SparkSession, path: str) -> DataFrame:
    return textio.parse_results(textio.with_line_numbers(spark.read.text(path)))


def report(queries: DataFrame, gt: DataFrame, pred: DataFrame, k: int, verbose: bool = False) -> None:
    per = evaluate.recall(queries, gt, pred, k)
    if verbose:
        for r in per.orderBy("qid").toLocalIterator():
            print(f"query {r.qid}: {r.recall:.4f}")
    s = evaluate.summary(per).first()
    if s.queries:
        print(f"Mean Recall@{k}: {s.mean_recall:.4f}\nMin: {s.min_recall:.4f}\nMax: {s.max_recall:.4f}\nPerfect: {s.perfect}/{s.queries}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodevec", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    for name, kind in (("algorithm", str), ("K", int), ("queries", str), ("vectors", str), ("format", str), ("strings", str), ("out", str)):
        s.add_argument(name, type=kind)
    s.add_argument("options", nargs="*")
    r = sub.add_parser("recall")
    r.add_argument("--gt", required=True)
    r.add_argument("--pred", required=True)
    r.add_argument("--K", type=int, default=10)
    r.add_argument("--verbose", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "recall":
        lines = textio.with_line_numbers(spark.read.text(a.gt)).select(F.col("id").alias("qid"))
        if lines.count() != spark.read.text(a.pred).count():
            parser.error("ground truth and result differ in their numbers of queries")
        report(lines, results(spark, a.gt), results(spark, a.pred), a.K, a.verbose)
        return 0
    if a.algorithm not in search.STRATEGIES:
        parser.error(f"unknown algorithm {a.algorithm}; one of {sorted(search.STRATEGIES)}")
    given = dict(w.split("=", 1) for w in a.options if "=" in w)
    build = BUILD | {k: int(given[k]) for k in BUILD if k in given}
    options = search.parse_options(a.algorithm, [w for w in a.options if w.split("=", 1)[0] not in (*BUILD, "gt")])
    lines = textio.with_line_numbers(spark.read.text(a.queries))
    queries = written(textio.parse_queries(lines), "queries")
    corpus = corpus_of(spark, a.vectors, a.format, a.strings)
    began = time.perf_counter()
    got = written(run(a.algorithm, corpus, queries, a.K, build, options), "results")
    ms, n = (time.perf_counter() - began) * 1000, queries.count()
    got.write.mode("overwrite").parquet(f"{a.out}/table")
    text = textio.format_results(lines.select(F.col("id").alias("qid")), got)
    text.orderBy("qid").select("value").coalesce(1).write.mode("overwrite").text(f"{a.out}/text")
    print(f"{n} queries in {ms:.1f} ms, {1000 * n / max(ms, 1e-9):.2f} a second")
    if "gt" in given:
        report(queries, results(spark, given["gt"]), got, a.K)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
