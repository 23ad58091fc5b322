"""Recall of predictions against a ground truth, both (qid, rank, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(queries: DataFrame, gt: DataFrame, pred: DataFrame, k: int = 10, denominator: str = "min") -> DataFrame:
    """(qid, hits, wanted, recall) for every qid of queries.

    The ground truth is cut to rank k; predictions count whole, repeats once. A query without ground truth has recall
    1, or 0 with denominator 'k', which divides by k whatever the size of the ground truth.
    """
    if denominator not in ("min", "k"):
        raise ValueError("denominator is 'min' or 'k'")
    want = gt.filter(F.col("rank") <= k).select("qid", "id").distinct()
    hit = pred.select("qid", "id").distinct().withColumn("hit", F.lit(1))
    per = want.join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    all_q = queries.select("qid").distinct().join(per, "qid", "left")
    hits, wanted = F.coalesce("hits", F.lit(0).cast("long")), F.coalesce("wanted", F.lit(0).cast("long"))
    r = hits / k if denominator == "k" else F.when(wanted == 0, F.lit(1.0)).otherwise(hits / wanted)
    return all_q.select("qid", hits.alias("hits"), wanted.alias("wanted"), r.alias("recall"))


def summary(per_query: DataFrame) -> DataFrame:
    """One row: queries, mean, least and greatest recall, and the number of perfect queries."""
    r = F.col("recall")
    return per_query.agg(
        F.count("*").alias("queries"), F.avg(r).alias("mean_recall"), F.min(r).alias("min_recall"),
        F.max(r).alias("max_recall"), F.count_if(r >= 1 - 1e-9).alias("perfect"),
    )
