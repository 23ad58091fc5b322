"""Vector functions on array columns, in double precision; and numpy forms of the same for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(_d(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where one of the two is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - inner_product(a, b) / n)


METRICS = {"l2": l2, "ip": negative_inner_product, "cosine": cosine_distance}


def usable(c: Column, dim: int) -> Column:
    """Not null, of full length, no null or NaN inside, not all zero. Never null itself."""
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(c.isNotNull() & (F.size(c) == dim) & whole & F.exists(c, lambda x: x != 0), F.lit(False))


def sub_vector(c: Column, part: int, sub_dim: int) -> Column:
    return F.slice(c, part * sub_dim + 1, sub_dim)


def format_vector(c: Column) -> Column:
    """Six decimals, single blanks between."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x.cast("double"))), " ")


def parse_vector(c: Column) -> Column:
    """Inverse of format_vector; takes brackets and commas too. Parts that are no numbers become null."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[\[\],\s]+", " ")), " ")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.try_cast("float"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype: str = "f4", zeros: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable rows, their vectors as rows of a matrix) of a list column; zeros: all-zero ones too."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, "i8"), np.zeros((0, dim), dtype)
    sizes = np.diff(column.offsets.to_numpy())
    good = np.asarray(column.is_valid()) & (sizes == dim)
    at = np.flatnonzero(good)
    if not len(at):
        return at, np.zeros((0, dim), dtype)
    if len(at) < n:
        column = column.take(pa.array(at))
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype, copy=False)
    fine = ~np.isnan(x).any(1) & (zeros | (x != 0).any(1))
    return (at, x) if fine.all() else (at[fine], x[fine])
