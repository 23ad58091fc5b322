"""Parameter sweeps: strategies over a grid of options, with recall and times as a metrics table."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.operators import cluster, evaluate, exact, gramindex, pq, search
from lodevec.session import written

METRICS = "method string, param string, param_value string, queries long, recall_pct double, min_recall double, perfect long, avg_time_ms double, qps double"


def sweep(queries: DataFrame, truth: DataFrame, runs: list[tuple[str, str, object, Callable[[], DataFrame]]], k: int = 10) -> DataFrame:
    """One row a run (method, param, value, function that gives its result). Times are of the whole batch, divided by
    its queries; results are materialised once."""
    spark, rows = queries.sparkSession, []
    n = queries.count()
    for method, param, value, run in runs:
        began = time.perf_counter()
        pred = written(run().select("qid", "id"), "sweep-found")
        ms = (time.perf_counter() - began) * 1000
        s = evaluate.summary(evaluate.recall(queries, truth, pred, k)).first()
        rows.append((method, param, str(value), n, 100 * s.mean_recall if n else None, s.min_recall, s.perfect, ms / n if n else None, 1000 * n / ms))
    return spark.createDataFrame(rows, METRICS)


def _built(rows: DataFrame, centroids: DataFrame, book: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = written(centroids, "sweep-centroids")
    member = written(cluster.assign(rows, c).select("id", "cluster_id"), "sweep-membership")
    grams = written(gramindex.gram_index(rows.join(member, "id"), "cluster_id"), "sweep-grams")
    return c, grams, written(search.index_rows(rows, member, pq.encode(rows, book)), "sweep-rows")


def clusters_by_ef(rows: DataFrame, queries: DataFrame, book: DataFrame, clusters: tuple[int, ...], efs: tuple[int, ...], k: int = 10, iterations: int = 5) -> DataFrame:
    """The clustered search over a grid of cluster counts and ef. One index is built for each count."""
    truth, runs = written(exact.groundtruth(rows, queries, k), "sweep-truth"), []
    for n in clusters:
        c, grams, indexed = _built(rows, cluster.kmeans(rows, n, iterations), book)
        runs += [("ann", f"clusters={n} ef", ef, lambda c=c, g=grams, i=indexed, ef=ef: search.ann(rows, queries, c, None, g, book, None, k, ef, rows=i)) for ef in efs]
    return sweep(queries, truth, runs, k)


def classes_by_ef(rows: DataFrame, queries: DataFrame, centroids: DataFrame, book: DataFrame, efs: tuple[int, ...], k: int = 10) -> DataFrame:
    """The clustered search over a grid of pattern classes (queries.style) and ef, on one index."""
    c, grams, indexed = _built(rows, centroids, book)
    out = []
    for (style,) in sorted(queries.select("style").distinct().collect()):
        q = queries.filter(F.col("style") == style)
        truth = written(exact.groundtruth(rows, q, k), "sweep-truth")
        runs = [("ann", f"class={style} ef", ef, lambda q=q, ef=ef: search.ann(rows, q, c, None, grams, book, None, k, ef, rows=indexed)) for ef in efs]
        out.append(sweep(q, truth, runs, k))
    return reduce(DataFrame.unionByName, out)


def together(per_dataset: dict[str, DataFrame]) -> DataFrame:
    """Metrics tables of several datasets as one, with a dataset column."""
    return reduce(DataFrame.unionByName, (df.withColumn("dataset", F.lit(name)) for name, df in per_dataset.items()))


def write_csv(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)
