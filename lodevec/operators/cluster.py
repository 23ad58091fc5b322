"""k-means over (id, vec), one level or two, and the ranking of clusters for a query.

Rows with a null id or a vec that is not usable take no part. Centroids are (cluster_id, centroid); the number of clusters is a parameter,
so centroids are small by definition and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.session import small, written


def centroid_list(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) ordered by id."""
    got = centroids.select("cluster_id", "centroid").orderBy("cluster_id").collect()
    return np.array([r[0] for r in got], "i8"), np.array([r[1] for r in got], "f8")


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, squared distance) of the nearest centroid; of equal ones the first. The two best by the fast form are
    compared again by the plain one, whose value does not hang on the order of a matrix product."""
    if len(c) == 1:
        return np.zeros(len(x), "i8"), np.square(x - c[0]).sum(1)
    fast = np.square(c).sum(1)[None] - 2 * x @ c.T
    two = np.sort(np.argpartition(fast, 1, 1)[:, :2], 1)
    d = np.stack([np.square(x - c[two[:, j]]).sum(1) for j in (0, 1)], 1)
    pick = (d[:, 1] < d[:, 0]).astype("i8")
    rows = np.arange(len(x))
    return two[rows, pick], d[rows, pick]


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster_id, dist): each row's nearest centroid by L2, of equal ones the lowest cluster_id."""
    names, c = centroid_list(centroids)
    out = "id long, cluster_id int, dist double"
    if not len(names):
        return rows.sparkSession.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = V.matrix(b.column("vec"), c.shape[1], "f8")
            if len(at):
                best, d = nearest(x, c)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(names[best].astype("i4")), pa.array(np.sqrt(d))],
                    names=["id", "cluster_id", "dist"],
                )

    return rows.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, out)


def update(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_id, centroid): mean vector of each cluster's members, in double precision. Every task sums its own rows
    and sends one vector a cluster, so a large cluster is no hot key."""
    joined = rows.select("id", F.col("vec").cast("array<float>").alias("vec")).join(membership.select("id", F.col("cluster_id").cast("long").alias("cluster_id")).filter("cluster_id is not null"), "id")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            sizes = np.diff(b.column("vec").offsets.to_numpy()) if b.num_rows else np.zeros(0, "i8")
            for dim in np.unique(sizes[sizes > 0]):
                at, x = V.matrix(b.column("vec"), int(dim), "f8", zeros=True)
                c = b.column("cluster_id").to_numpy()[at]
                for k in np.unique(c):
                    mine = x[c == k]
                    total[int(k), int(dim)] = total.get((int(k), int(dim)), 0) + np.append(mine.sum(0), len(mine))
        for (k, _), s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s[-1]]), pa.array([s[:-1].tolist()], pa.list_(pa.float64()))], names=["k", "n", "s"])

    parts = joined.select("cluster_id", "vec").mapInArrow(sums, "k long, n double, s array<double>")
    means = parts.select("k", "n", F.posexplode("s").alias("pos", "x")).groupBy("k", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    out = means.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return out.select(F.col("k").cast("int").alias("cluster_id"), "centroid")


def _sums(c: np.ndarray):
    """mapInArrow function: per task the count, vector sum and change of each centroid's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(c), "i8"), np.zeros(c.shape)
        for b in batches:
            at, x = V.matrix(b.column("vec"), c.shape[1], "f8")
            if len(at):
                best, _ = nearest(x, c)
                order = np.argsort(best, kind="stable")
                which, start = np.unique(best[order], return_index=True)
                n[which] += np.diff([*start, len(order)])
                s[which] += np.add.reduceat(x[order], start)
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([n[k]]), pa.array([s[k].tolist()], pa.list_(pa.float64()))], names=["k", "n", "s"]
            )

    return run


def kmeans(rows: DataFrame, k: int, max_iter: int = 30, seed: int = 42) -> DataFrame:
    """(cluster_id, centroid) by Lloyd's iterations until nothing moves. Starts from the k rows that come first by a
    seeded hash of the id. An empty cluster keeps its centroid. k is cut to the number of usable rows."""
    spark = rows.sparkSession
    dim = rows.select(F.size("vec").alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    schema = "cluster_id int, centroid array<double>"
    if dim is None:
        return spark.createDataFrame([], schema)
    good = written(rows.filter(V.usable(F.col("vec"), dim.d)).select("id", F.col("vec").cast("array<float>").alias("vec")), "kmeans-rows")
    start = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()
    if not start:
        return spark.createDataFrame([], schema)
    c = np.array([r.vec for r in start], "f8")
    for _ in range(max_iter):
        new = c.copy()
        parts = good.mapInArrow(_sums(c), "k long, n long, s array<double>")
        for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim.d)]).alias("s")).collect():
            new[r.k] = np.array(r.s) / r.n
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-6:
            break
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], schema)


def cluster_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster_id").agg(F.count("*").alias("members"))


def rank_clusters(queries: DataFrame, centroids: DataFrame, nprobe: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, cluster_id, dist, rank): clusters by distance of their centroid, only those of allowed (qid, cluster_id)
    where given, the nprobe first where it is above 0. Both sides are small: a query batch and a centroid table."""
    pairs = queries.select("qid", "qvec").join(small(centroids.select("cluster_id", "centroid"), 1024))
    if allowed is not None:
        pairs = pairs.join(allowed.select("qid", "cluster_id"), ["qid", "cluster_id"], "left_semi")
    d = pairs.select("qid", "cluster_id", V.l2(F.col("centroid"), F.col("qvec")).alias("dist"))
    out = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "cluster_id")).cast("long"))
    return out.filter(F.col("rank") <= nprobe) if nprobe > 0 else out


def hierarchical(rows: DataFrame, k0: int, k1: int, max_iter: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two levels: (coarse_id, centroid), (fine_id, coarse_id, centroid), (id, fine_id, coarse_id).

    Each coarse cluster is split into at most k1 fine ones, all coarse clusters at once: a fine centroid starts from a
    row of its own coarse cluster, and in each iteration a row looks only at the fine centroids of that cluster.
    """
    coarse = written(kmeans(rows, k0, max_iter, seed).withColumnRenamed("cluster_id", "coarse_id"), "coarse")
    spark = rows.sparkSession
    names, c0 = centroid_list(coarse.withColumnRenamed("coarse_id", "cluster_id"))
    fine_schema = "fine_id int, coarse_id int, centroid array<double>"
    if not len(names):
        return coarse, spark.createDataFrame([], fine_schema), spark.createDataFrame([], "id long, fine_id int, coarse_id int")
    member = assign(rows, coarse.withColumnRenamed("coarse_id", "cluster_id")).select("id", F.col("cluster_id").alias("coarse_id"))
    first = Window.partitionBy("coarse_id").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    seeds = member.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k1).join(rows.select("id", "vec"), "id")
    got = seeds.orderBy("coarse_id", "r").select("coarse_id", "vec").collect()
    owner, c1 = np.array([r.coarse_id for r in got]), np.array([r.vec for r in got], "f8")

    def route(x: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, _ = nearest(x, c0)
        fine = np.zeros(len(x), "i8")
        for k in np.unique(up):
            own, mine = np.flatnonzero(owner == k), np.flatnonzero(up == k)
            if len(own):
                fine[mine] = own[nearest(x[mine], c1[own])[0]]
        return up, fine

    def sums(c1: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(len(c1), "i8"), np.zeros(c1.shape)
            for b in batches:
                at, x = V.matrix(b.column("vec"), c1.shape[1], "f8")
                if len(at):
                    _, fine = route(x, c1)
                    n += np.bincount(fine, minlength=len(c1))
                    np.add.at(s, fine, x)
            keep = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep), pa.array(n[keep]), pa.array(s[keep].tolist(), pa.list_(pa.float64()))], names=["k", "n", "s"]
            )

        return run

    plain = written(rows.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")), "fine-rows")
    dim = c1.shape[1]
    for _ in range(max_iter):
        new = c1.copy()
        parts = plain.mapInArrow(sums(c1), "k long, n long, s array<double>")
        for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")).collect():
            new[r.k] = np.array(r.s) / r.n
        moved, c1 = np.abs(new - c1).max(), new
        if moved < 1e-6:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = V.matrix(b.column("vec"), c1.shape[1], "f8")
            if len(at):
                up, fine = route(x, c1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(fine.astype("i4")), pa.array(names[up].astype("i4"))],
                    names=["id", "fine_id", "coarse_id"],
                )

    fine = spark.createDataFrame([(i, int(names[owner[i]]), [float(x) for x in c1[i]]) for i in range(len(c1))], fine_schema)
    return coarse, fine, plain.mapInArrow(label, "id long, fine_id int, coarse_id int")
