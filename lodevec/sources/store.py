"""Indexes as Parquet tables with a manifest that is checked on loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table of an index -> column its files are sorted by, so that row groups can be skipped.
TABLES = {"centroids": "cluster_id", "membership": "cluster_id", "gram_index": "gram", "codebook": "sub", "codes": "id", "edges": "src", "fine": "fine_id", "rows": "cluster_id"}
#: Tables that are stored by cluster, so that a search reads its clusters only.
BY_CLUSTER = {"membership", "rows"}


class IndexMismatch(ValueError):
    """A stored index is incomplete or belongs to another corpus."""


def save(index: dict[str, DataFrame], path: str, corpus_rows: int, **facts: int) -> None:
    """Tables under path, membership and rows partitioned by cluster; the manifest comes last, so a broken save does not load."""
    spark = next(iter(index.values())).sparkSession
    counts = {}
    for name, df in index.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}; one of {sorted(TABLES)}")
        writer = df.sortWithinPartitions(TABLES[name]).write.mode("overwrite")
        (writer.partitionBy("cluster_id") if name in BY_CLUSTER else writer).parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    rows = [("rows:" + k, v) for k, v in counts.items()] + [("corpus_rows", corpus_rows), *facts.items()]
    spark.createDataFrame(rows, "key string, value long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, corpus_rows: int | None = None, **facts: int) -> dict[str, DataFrame]:
    """The tables of a stored index. IndexMismatch where there is no manifest, a table's rows are not those written,
    or corpus_rows or a fact differs."""
    try:
        manifest = {r["key"]: r["value"] for r in spark.read.schema("key string, value long").json(f"{path}/manifest").collect()}
    except Exception as e:
        raise IndexMismatch(f"{path} has no manifest") from e
    for k, v in {**({} if corpus_rows is None else {"corpus_rows": corpus_rows}), **facts}.items():
        if manifest.get(k) != v:
            raise IndexMismatch(f"{path}: {k} is {manifest.get(k)}, not {v}")
    out = {}
    for name in (k[5:] for k in manifest if k.startswith("rows:")):
        out[name] = spark.read.parquet(f"{path}/{name}")
        if out[name].count() != manifest["rows:" + name]:
            raise IndexMismatch(f"{path}: {name} is incomplete")
    return out


def listing(membership: DataFrame, ids_a_line: int = 1000) -> DataFrame:
    """(cluster_id, part, members, ids): assignments as text, a line for each range of ids_a_line ids, so that a cluster
    of any size is many short lines; ids in order, repeated rows once. Null clusters and ids are left out."""
    rows = membership.filter("cluster_id is not null and id is not null").select("cluster_id", F.floor(F.col("id") / ids_a_line).alias("part"), "id").distinct()
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ")
    return rows.groupBy("cluster_id", "part").agg(F.count("*").alias("members"), ids.alias("ids"))
