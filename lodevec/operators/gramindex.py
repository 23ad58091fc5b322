"""Inverted trigram indexes, over clusters or over rows, and their evaluation under a query plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.session import small


def gram_index(rows: DataFrame, key: str) -> DataFrame:
    """Distinct (gram, key) over rows with columns str and key. Null texts, null keys and texts below three characters
    add nothing. Repeats inside a row are dropped before the shuffle."""
    grams = F.array_distinct(T.trigrams(T.preprocess(F.col("str"))))
    return rows.filter(F.col(key).isNotNull()).select(F.explode(grams).alias("gram"), key).distinct()


def posting_stats(index: DataFrame, key: str) -> DataFrame:
    """(gram, postings): length of each posting list."""
    return index.groupBy("gram").agg(F.count_distinct(key).alias("postings"))


def candidates(dnf: DataFrame, index: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """(qid, key) of all keys that hold every gram of at least one conjunction of the query.

    index: distinct (gram, key). keys: all keys, for queries without a constraint. The plan side is small by its own
    cap and is broadcast while its size allows; the division is a count per (qid, conj_id, key), so no posting list meets one task.
    """
    need = dnf.filter("gram is not null")
    held = index.join(small(need, 32), "gram").groupBy("qid", "conj_id", "n_grams", key).agg(F.count("*").alias("n"))
    some = held.filter("n = n_grams").select("qid", key)
    every = keys.select(key).filter(F.col(key).isNotNull()).distinct().join(small(dnf.filter("gram is null").select("qid"), 16))
    return some.unionByName(every.select("qid", key)).distinct()
