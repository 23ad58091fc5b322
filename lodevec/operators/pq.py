"""Product quantisation: codebooks per sub-space, codes, and asymmetric distances.

codebook: (sub, code, centroid), at most 256 codes a sub-space. codes: (id, code array<smallint>).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators.cluster import nearest
from lodevec.session import small

CODEBOOK = "sub int, code int, centroid array<double>"


def fitting_m(dim: int, m: int) -> int:
    """The largest number of sub-spaces up to m that divides dim."""
    return next(x for x in range(min(m, dim), 0, -1) if dim % x == 0)


def train(rows: DataFrame, dim: int, m: int = 8, k_sub: int = 256, iters: int = 25, seed: int = 42, sample: int = 20_000) -> DataFrame:
    """Codebooks by k-means in each sub-space, all sub-spaces at once, on the `sample` usable rows that come first by
    a seeded hash (a documented bound: codebooks are small models; encoding covers every row)."""
    if k_sub > 256 or k_sub < 1:
        raise ValueError("a code has one byte: k_sub is 1 to 256")
    if dim % m:
        raise ValueError("m must divide the dimension; see fitting_m")
    sub = dim // m
    good = rows.filter(V.usable(F.col("vec"), dim)).select("id", "vec")
    part = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    each = part.select("id", F.posexplode(F.array(*[V.sub_vector(F.col("vec"), s, sub) for s in range(m)])).alias("sub", "v"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf.v.values).astype("f8")
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(k_sub, len(x)), replace=False)]
        for _ in range(iters):
            best, d = nearest(x, c)
            n = np.bincount(best, minlength=len(c))
            new = np.zeros_like(c)
            np.add.at(new, best, x)
            new[n > 0] /= n[n > 0, None]
            for e, far in zip(np.flatnonzero(n == 0), np.argsort(-d)):
                new[e] = x[far]
            if np.allclose(new, c):
                break
            c = new
        return pd.DataFrame({"sub": np.int32(pdf["sub"].iloc[0]), "code": np.arange(len(c), dtype="i4"), "centroid": list(c)})

    return each.groupBy("sub").applyInPandas(fit, CODEBOOK)


def books(codebook: DataFrame) -> np.ndarray:
    """[sub][code][sub_dim]; at most 256 codes a sub-space."""
    got = codebook.orderBy("sub", "code").collect()
    if not got:
        return np.zeros((0, 0, 0))
    m = 1 + max(r["sub"] for r in got)
    return np.array([[r.centroid for r in got if r["sub"] == s] for s in range(m)], "f8")


def encode(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """(id, code): the nearest code word of each slice, of equal ones the lowest code. Unusable rows and rows with a
    null id have no code; with an empty codebook no row has."""
    b = books(codebook)
    m, _, sub = b.shape
    if not m:
        return rows.sparkSession.createDataFrame([], "id long, code array<smallint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = V.matrix(batch.column("vec"), m * sub, "f8")
            if len(at):
                codes = np.stack([nearest(x[:, s * sub : (s + 1) * sub], b[s])[0] for s in range(m)], 1).astype("i2")
                offsets = pa.array(np.arange(0, len(at) * m + 1, m, dtype="i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "code"]
                )

    return rows.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, "id long, code array<smallint>")


def distance_table(queries: DataFrame, codebook: DataFrame, sub_dim: int) -> DataFrame:
    """(qid, sub, code, d2): squared distance of each query slice to each code word."""
    pairs = queries.select("qid", "qvec").join(small(codebook, 1024))
    piece = F.slice(F.col("qvec"), F.col("sub") * sub_dim + 1, F.lit(sub_dim))
    return pairs.select("qid", "sub", "code", V.squared_l2(F.col("centroid"), piece).alias("d2"))


def lookup(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[sub][code] squared distances of one query."""
    m, _, sub = b.shape
    return np.square(b - q.reshape(m, 1, sub)).sum(2)


def adc(code: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Asymmetric (squared) distance of each code row: the sum over sub-spaces, from first to last."""
    total = np.zeros(len(code))
    for s in range(lut.shape[0]):
        total += lut[s, code[:, s]]
    return total


def adc_column(code: Column, lut: Column) -> Column:
    """The same as an expression; lut is array<array<double>>."""
    return F.aggregate(F.zip_with(code, lut, lambda c, t: F.get(t, c.cast("int"))), F.lit(0.0), lambda a, x: a + x)
