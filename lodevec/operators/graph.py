"""Neighbour graphs over (id, vec), per build where a build_id is present."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.functions import vector as V
from lodevec.operators.cluster import centroid_list

#: Rows of one block. A pair of blocks is one task's work: two vectors sets and a strip of distances in memory.
BLOCK = 16_384
_EDGE = "build_id int, src long, dst long, dist double"


def knn_edges(rows: DataFrame, dim: int, k: int = 16) -> DataFrame:
    """(build_id, src, dst, dist, rank): the exact k nearest other rows of the build for every usable row, by
    (distance, id). Rows: (id, build_id, vec); those with a null id or build_id or an unusable vec take no part.

    A build is cut into blocks by a hash of the id, about BLOCK rows each; every ordered pair of blocks is one unit of
    work, found by one matrix product in strips, and gives at most k candidates a row. Work is quadratic in a build,
    as exactness wants; the index-backed way is the similarity search over binary codes.
    """
    good = _good(rows, dim)
    blocks = good.groupBy("build_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    placed = good.join(F.broadcast(blocks), "build_id").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    return _met(placed.withColumn("cell", F.lit(0)), placed.withColumn("cell", F.lit(0)), k)


def cell_edges(rows: DataFrame, centroids: DataFrame, dim: int, k: int = 16, nprobe: int = 4) -> DataFrame:
    """As knn_edges, but a row looks only at the rows whose nearest centroid is one of its own nprobe nearest: work grows
    with the rows of a few cells, not with the build. Edges that leave these cells are missed. centroids: (cluster_id,
    centroid)."""
    names, c = centroid_list(centroids)
    good = _good(rows, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, x = V.matrix(b.column("vec"), dim, "f8")
                d = np.square(c).sum(1)[None] - 2 * x @ c.T
                near = np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype("i4")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(names[near].astype("i4")), pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    celled = good.mapInArrow(run, "id long, build_id int, vec array<float>, cells array<int>")
    own = celled.select("id", "build_id", "vec", F.col("cells")[0].alias("cell"))
    blocks = own.groupBy("build_id", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    here = own.join(F.broadcast(blocks), ["build_id", "cell"])
    asking = celled.select("id", "build_id", "vec", F.explode("cells").alias("cell")).join(F.broadcast(blocks), ["build_id", "cell"])
    b = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    return _met(asking.withColumn("b", b), here.withColumn("b", b), k)


def _good(rows: DataFrame, dim: int) -> DataFrame:
    good = rows.filter("id is not null and build_id is not null").filter(V.usable(F.col("vec"), dim))
    return good.select(F.col("id").cast("long").alias("id"), F.col("build_id").cast("int").alias("build_id"), F.col("vec").cast("array<float>").alias("vec"))


def _met(asking: DataFrame, here: DataFrame, k: int) -> DataFrame:
    """Every block of the asking rows with every block of those here, cell by cell; of each row the k nearest."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    as_query = asking.select("*", other).select("build_id", "cell", F.col("b").alias("qb"), F.col("o").alias("xb"), F.lit(True).alias("is_query"), "id", "vec")
    as_item = here.select("*", other).select("build_id", "cell", F.col("o").alias("qb"), F.col("b").alias("xb"), F.lit(False).alias("is_query"), "id", "vec")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf.is_query], pdf[~pdf.is_query]
        if not len(q) or not len(x):
            return pd.DataFrame({"build_id": [], "src": [], "dst": [], "dist": []})
        a, b = np.stack(q.vec.values).astype("f8"), np.stack(x.vec.values).astype("f8")
        qi, order = q.id.values, np.argsort(x.id.values)
        b, xi = b[order], x.id.values[order]
        own = np.searchsorted(xi, qi)
        own = np.where((own < len(xi)) & (xi[np.minimum(own, len(xi) - 1)] == qi), own, -1)
        b2, out = np.square(b).sum(1), []
        slack = 1e-12 * (b2.max() + np.square(a).sum(1).max())
        for i in range(0, len(a), 256):
            fast = b2[None] - 2 * a[i : i + 256] @ b.T
            me = own[i : i + 256]
            fast[np.flatnonzero(me >= 0), me[me >= 0]] = np.inf
            bound = np.partition(fast, k - 1, 1)[:, k - 1] + slack if fast.shape[1] > k else np.full(len(fast), np.finfo("f8").max)
            row, col = np.nonzero(fast <= bound[:, None])
            dist = np.concatenate([np.square(a[i + row[s : s + 100_000]] - b[col[s : s + 100_000]]).sum(1) for s in range(0, len(row), 100_000)] or [np.zeros(0)])
            by = np.lexsort((xi[col], dist, row))
            row, col, dist = row[by], col[by], dist[by]
            start = np.searchsorted(row, np.arange(len(fast)))
            first = np.arange(len(row)) - start[row] < k
            out.append(pd.DataFrame({"src": qi[i + row[first]], "dst": xi[col[first]], "dist": np.sqrt(dist[first])}))
        got = pd.concat(out, ignore_index=True)
        got.insert(0, "build_id", pdf.build_id.iloc[0])
        return got

    found = as_query.unionByName(as_item).groupBy("build_id", "cell", "qb", "xb").applyInPandas(work, _EDGE)
    w = Window.partitionBy("build_id", "src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def symmetric(edges: DataFrame, m: int) -> DataFrame:
    """(src, dst, dist): edges and their reverse, of each source the m nearest."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= m).drop("r")


def shared_grams(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, dst, shared): number of distinct trigrams the texts of both ends share; texts in the letters-only form.
    A null text shares nothing."""
    grams = rows.select("id", F.coalesce(F.array_distinct(T.trigrams(T.preprocess_letters(F.col("str")))), F.array().cast("array<string>")).alias("g"))
    left = edges.select("src", "dst").join(grams.select(F.col("id").alias("src"), F.col("g").alias("gs")), "src")
    both = left.join(grams.select(F.col("id").alias("dst"), F.col("g").alias("gd")), "dst")
    return both.select("src", "dst", F.size(F.array_intersect("gs", "gd")).cast("long").alias("shared"))
