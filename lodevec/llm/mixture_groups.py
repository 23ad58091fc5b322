"""Groups of similar records by a Gaussian mixture, fitted by expectation-maximisation.

Features are standardised and reduced to principal axes, from sums over all rows. Rows are laid out by locality (signs
along the first axes), in blocks. Every block finds its own dense spots; spots of all blocks, as counts and means, are
then merged under several widths, which gives mixtures with different numbers of components. One pass over all rows
gives each mixture's likelihood, the Bayesian information criterion chooses one a build, and EM refines it: a component
has a weight, a mean and a diagonal covariance drawn towards the pooled one, and a broad background component takes
what belongs nowhere. Rows go to the component of greatest density, and a group keeps exactly the rows whose cosine
with its mean is high enough. Its most typical members are those of greatest density.

A group that holds a third of a build is many blocks and at no time one task; EM statistics are one row a task and
component. Parameters (a few hundred bytes a component) are what the driver sees; rows, ids and links it does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.session import BROADCAST_LIMIT, written

#: Axes kept, rows of a block, spots merged at once and pairs of them listed, widths tried, prior rows behind a covariance.
AXES, BLOCK, MERGE_MOST, LISTED_MOST = 48, 4096, 16_384, 20_000_000
WIDTHS = (0.7, 1.0, 1.4)
PRIOR_ROWS, LEAST_ROWS, EM_ROUNDS = 10.0, 3, 8
#: Times the variance of all rows that the background has: a build that is one group is that group, not background.
BROAD = 2.0
#: Variance below which an axis is none.
LEAST_VAR = 1e-3


@dataclass
class Space:
    """Standardised, reduced features of a build: (x - mean) @ axes, with the variance along each axis. Few rows span
    few axes; along the others, not live, all is 0 and says nothing."""

    mean: np.ndarray
    axes: np.ndarray
    var: np.ndarray
    live: np.ndarray
    rows: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes


@dataclass
class Mixture:
    """weight[k], mean[k][q], var[k][q]; background is the weight of the component with BROAD times the space's own spread."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    background: float

    def log_density(self, z: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
        """(weighted log densities [n][k], of the background [n])."""
        iv = (1 / self.var).astype("f4")
        const = np.log(np.maximum(self.weight, 1e-12)) - 0.5 * (np.log(self.var).sum(1) + (self.mean**2 / self.var).sum(1))
        lp = np.square(z) @ (-0.5 * iv.T)
        lp += z @ (self.mean / self.var).T.astype("f4")
        lp += const.astype("f4")
        broad = BROAD * space.var
        bg = math.log(max(self.background, 1e-12)) - 0.5 * (np.log(broad).sum() + (np.square(z) / broad).sum(1))
        return lp, bg


def _raw(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(build, ids, vectors) chunks, one build each, of (build_id, id, raw) batches."""
    for b in batches:
        if not b.num_rows:
            continue
        build, ids = b.column("build_id").to_numpy(), b.column("id").to_numpy()
        buf = b.column("raw")
        x = np.frombuffer(b"".join(buf.to_pylist()), "<f4").reshape(-1, dim)
        for k in np.unique(build):
            at = np.flatnonzero(build == k)
            for i in range(0, len(at), rows):
                yield int(k), ids[at[i : i + rows]], x[at[i : i + rows]]


def _moments(vectors: DataFrame, dim: int) -> dict[int, Space]:
    """The space of every build, from sums over all its rows."""
    size = 1 + dim + dim * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            at, x = V.matrix(b.column("vec"), dim, "f8")
            build = b.column("build_id").to_numpy()[at]
            for k in np.unique(build):
                y = x[build == k]
                total.setdefault(int(k), np.zeros(size))
                total[int(k)] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["build_id", "s"])

    parts = vectors.mapInArrow(run, "build_id long, s array<double>").select("build_id", F.posexplode("s").alias("pos", "x"))
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("build_id", "pos").agg(F.sum("x").alias("x")).toLocalIterator():
        sums.setdefault(r.build_id, np.zeros(size))[r.pos] = r.x
    out = {}
    for k, s in sums.items():
        n, mean = s[0], s[1 : 1 + dim] / s[0]
        cov = s[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        var, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        top = np.argsort(-var)[: min(AXES, dim)]
        live = var[top] > LEAST_VAR
        out[k] = Space(mean.astype("f4"), (axes[:, top] * live / scale[:, None]).astype("f4"), np.where(live, var[top], 1).astype("f4"), live, int(n))
    return out


def _cell(z: np.ndarray, bits: int, skip: int = 0) -> np.ndarray:
    """Cell of a row: the signs along `bits` axes."""
    bits = min(bits, z.shape[1] - skip)
    return (z[:, skip : skip + bits] > 0) @ (1 << np.arange(bits)) if bits > 0 else np.zeros(len(z), "i8")


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of equal rows, ascending; for each row the number of its first in these)."""
    x = np.ascontiguousarray(x)
    _, first, of = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return np.sort(first), rank[of]


def spots(z: np.ndarray) -> tuple[np.ndarray, float]:
    """(label of each row, squared radius): dense spots of a block, found greedily from the row with most neighbours.
    The radius follows from the distances of near neighbours, so rows must be distinct: among copies it would be 0."""
    n = len(z)
    z2 = np.einsum("ij,ij->i", z, z)
    d = np.maximum(z2[:, None] + z2[None] - 2 * (z @ z.T), 0)
    np.fill_diagonal(d, np.inf)
    near = np.partition(d, min(3, n - 1) - 1, 1)[:, min(3, n - 1) - 1] if n > 1 else np.ones(n)
    scale = float(np.quantile(near[np.isfinite(near)], 0.25)) if n > 1 else 1.0
    radius = max(2.2 * scale, 1e-6)
    degree = (d <= 3.2 * scale).sum(1)
    label = np.full(n, -1)
    free, k = np.ones(n, "?"), 0
    for i in np.argsort(-degree, kind="stable"):
        if not free[i]:
            continue
        if degree[i] == 0:
            break
        member = np.flatnonzero(free & (d[i] <= 3.2 * scale))
        for _ in range(2):
            c = z[np.append(member, i)].mean(0)
            member = np.flatnonzero(free & (z2 - 2 * (z @ c) + c @ c <= 0.8 * radius))
            if not len(member):
                break
        member = np.unique(np.append(member, i))
        label[member], free[member] = k, False
        k += 1
    rest = np.flatnonzero(label < 0)
    label[rest] = k + np.arange(len(rest))
    return label, radius


#: own: distinct rows behind a spot; copies say nothing of the radius.
_SPOT = "build_id long, n long, own double, radius double, mean binary, square binary"


def _spot_batch(build: int, n: np.ndarray, own: np.ndarray, radius: np.ndarray, mean: np.ndarray, square: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), build)), pa.array(n.astype("i8")), pa.array(own.astype("f8")), pa.array(radius.astype("f8")),
         pa.array([m.tobytes() for m in mean.astype("<f4")], pa.binary()), pa.array([m.tobytes() for m in square.astype("<f4")], pa.binary())],
        names=["build_id", "n", "own", "radius", "mean", "square"],
    )


def merged(n: np.ndarray, mean: np.ndarray, square: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spots merged greedily from the largest: one joins where its mean lies as near as a sample of its size would.
    Each spot looks only at those so near that both could lie within reach of one mean, in directions of their own;
    where these are too many to list, at all that are left."""
    m2, reach = np.square(mean).sum(1), radius * (0.25 + 0.75 / n)
    rows, cols, listed = [], [], 0
    for i in range(0, len(n), 1024):
        d = m2[i : i + 1024, None] + m2[None] - 2 * mean[i : i + 1024] @ mean.T
        r, c = np.nonzero(d <= reach[i : i + 1024, None] + reach[None])
        rows.append(r + i)
        cols.append(c)
        listed += len(r)
        if listed > LISTED_MOST:
            break
    near = None
    if listed <= LISTED_MOST and len(n):
        start = np.searchsorted(np.concatenate(rows), np.arange(len(n) + 1))
        near = np.concatenate(cols)
    free, out = np.ones(len(n), "?"), []
    for lead in np.argsort(-n, kind="stable"):
        if not free[lead]:
            continue
        at = near[start[lead] : start[lead + 1]] if near is not None else np.arange(len(n))
        at = at[free[at]]
        at = np.append(at[at != lead], lead)
        if len(at) > 1:
            c, own = mean[lead], np.arange(len(at)) == len(at) - 1
            for _ in range(2):
                join = (np.square(mean[at] - c).sum(1) <= reach[at]) | own
                w = n[at[join]][:, None]
                c = (w * mean[at[join]]).sum(0) / w.sum()
            at = at[join]
        w = n[at][:, None]
        out.append((float(w.sum()), (w * mean[at]).sum(0) / w.sum(), (w * square[at]).sum(0) / w.sum()))
        free[at] = False
    return np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])


def _sum_rows(key: np.ndarray, weight: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of weights, weighted sum of rows)."""
    order = np.argsort(key, kind="stable")
    names, start = np.unique(key[order], return_index=True)
    return names, np.add.reduceat(weight[order], start), np.add.reduceat(weight[order][:, None] * z[order], start)


def one_mean(means: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """For each component the one it belongs to: the heaviest of those whose mean has a cosine of at least `least`
    with its own. No row is so near to the means of two groups, so such components are parts of one."""
    size = np.sqrt(np.square(means).sum(1))
    unit = means / np.maximum(size, 1e-12)[:, None]
    of, rank = np.arange(len(means)), np.argsort(np.argsort(-weight, kind="stable"), kind="stable")
    for i in range(0, len(means), 1024):
        near = unit[i : i + 1024] @ unit.T >= least
        near[np.arange(len(near)), np.arange(i, i + len(near))] = True
        of[i : i + 1024] = np.where(near, rank[None], len(means)).argmin(1)
    while (of[of] != of).any():
        of = of[of]
    return of


def joined(n: np.ndarray, s: np.ndarray, q: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of squares of components, those joined that are pieces of one: their means lie within half
    the spread of the pooled component and the information criterion gains by it. Pieces come from spots at the edge
    of a cell."""
    while len(n) > 1:
        mean, spread = s / n[:, None], np.maximum(q / n[:, None] - (s / n[:, None]) ** 2, 1e-4)
        near = 0.5 * (n[:, None] * spread).sum() / n.sum()
        m2 = np.square(mean).sum(1)
        gone = np.zeros(len(n), "?")
        for i in range(0, len(n), 1024):
            d = m2[i : i + 1024, None] + m2[None] - 2 * mean[i : i + 1024] @ mean.T
            for a, b in zip(*np.nonzero(d <= near)):
                a += i
                if a >= b or gone[a] or gone[b]:
                    continue
                both = np.maximum((q[a] + q[b]) / (n[a] + n[b]) - ((s[a] + s[b]) / (n[a] + n[b])) ** 2, 1e-4)
                loss = (n[a] + n[b]) * np.log(both).sum() - n[a] * np.log(spread[a]).sum() - n[b] * np.log(spread[b]).sum()
                if loss < (2 * s.shape[1] + 1) * math.log(max(rows, 2)):
                    n[a], s[a], q[a], gone[b] = n[a] + n[b], s[a] + s[b], q[a] + q[b], True
                    spread[a] = both
        if not gone.any():
            break
        n, s, q = n[~gone], s[~gone], q[~gone]
    return n, s, q


class Fit:
    """A mixture per build over vectors (id, build_id, vec)."""

    def __init__(self, vectors: DataFrame, dim: int) -> None:
        self.dim, self.spark = dim, vectors.sparkSession
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("build_id").cast("long").alias("build_id"), F.col("vec").cast("array<float>").alias("vec"))
        rows = rows.filter("id is not null and build_id is not null and vec is not null")
        self.spaces = _moments(rows, dim)
        self.models: dict[int, Mixture] = {}
        self.same: dict[int, np.ndarray] = {}
        if self.spaces:
            self.rows = self._laid_out(rows)
            self._fit()

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """(block, build_id, id, raw): usable rows by build and cell, cells cut to blocks, near blocks in one file."""
        dim, spaces = self.dim, self.spaces
        bits = {b: max(0, math.ceil(math.log2(s.rows / BLOCK))) for b, s in spaces.items()}
        first, n = {}, 0
        for b in sorted(bits):
            first[b] = n
            n += 1 << bits[b]

        def cells(batches: Iterator[pa.RecordBatch], size: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            count = np.zeros(n, "i8")
            for b in batches:
                at, x = V.matrix(b.column("vec"), dim)
                build, ids = b.column("build_id").to_numpy()[at], b.column("id").to_numpy()[at]
                cell = np.zeros(len(at), "i8")
                for k in np.unique(build):
                    mine = build == k
                    cell[mine] = first[int(k)] + _cell(spaces[int(k)](x[mine]), bits[int(k)])
                if size is None:
                    count += np.bincount(cell, minlength=n)
                elif len(at):
                    blocks = np.maximum(1, -(-size // BLOCK))
                    start = np.cumsum(blocks) - blocks
                    h = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    block = start[cell] + (h % blocks[cell].astype("u8")).astype("i8")
                    raw = pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(build), pa.array(ids), raw], names=["block", "build_id", "id", "raw"])
            if size is None:
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["cell", "n"])

        size = np.zeros(n, "i8")
        counted = rows.mapInArrow(lambda it: cells(it, None), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # one a cell; a cell is about a block of rows
            size[r.cell] = r.n
        blocks = int(np.maximum(1, -(-size // BLOCK)).sum())
        files = max(self.spark.sparkContext.defaultParallelism, -(-blocks // 64))
        files = min(files, blocks)
        placed = rows.mapInArrow(lambda it: cells(it, size), "block long, build_id long, id long, raw binary")
        return written(placed.repartitionById(files, F.floor(F.col("block") * files / blocks).cast("int")).sortWithinPartitions("block"), "laid-out")

    def _spots(self) -> DataFrame:
        dim, spaces = self.dim, self.spaces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            now = None

            def close() -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches(held)
                build = t.column("build_id")[0].as_py()
                x = np.frombuffer(b"".join(t.column("raw").to_pylist()), "<f4").reshape(-1, dim)
                for i in range(0, len(x), 2 * BLOCK):
                    z = spaces[build](x[i : i + 2 * BLOCK])
                    first, of = distinct(x[i : i + 2 * BLOCK])
                    label, radius = spots(z[first])
                    own = np.bincount(label)
                    label = label[of]
                    names, n, s = _sum_rows(label, np.ones(len(z)), z)
                    _, _, q = _sum_rows(label, np.ones(len(z)), z * z)
                    yield _spot_batch(build, n, own[names], np.full(len(n), radius), s / n[:, None], q / n[:, None])

            for b in batches:
                block = b.column("block").to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
                for s, e in zip(cut, cut[1:]):
                    if e > s:
                        if now is not None and block[s] != now:
                            yield from close()
                            held = []
                        now = block[s]
                        held.append(b.slice(s, e - s))
            if held:
                yield from close()

        return self.rows.mapInArrow(run, _SPOT)

    def _merge(self, found: DataFrame, width: float, cells: dict[int, int], skip: int, level: int) -> DataFrame:
        """Spots of each build and cell of their means merged under one width."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
                n = t.column("n").to_numpy().astype("f8")
                mean, square = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<f4").reshape(len(n), -1).astype("f8") for c in ("mean", "square"))
                radius, own = t.column("radius").to_numpy(), t.column("own").to_numpy()
                order = np.argsort(radius)
                mid = radius[order][np.searchsorted(np.cumsum(own[order]), own.sum() / 2)]
                cn, cm, cs = merged(n, mean, square, width * mid)
                yield _spot_batch(t.column("build_id")[0].as_py(), cn, np.full(len(cn), own.sum() / len(cn)), np.full(len(cn), mid), cm, cs)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    build = b.column("build_id").to_numpy()
                    mean = np.frombuffer(b"".join(b.column("mean").to_pylist()), "<f4").reshape(len(build), -1)
                    cell = np.zeros(len(build), "i8")
                    for k in np.unique(build):
                        cell[build == k] = _cell(mean[build == k], cells[int(k)], skip)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

        def group(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(run([t.combine_chunks()])))

        placed = found.mapInArrow(place, _SPOT + ", cell long")
        return placed.groupBy("build_id", "cell").applyInArrow(group, _SPOT)

    def _fit(self) -> None:
        found = written(self._spots(), "spots")
        skip, last = 0, math.inf
        while True:
            counts = {r.build_id: r["count"] for r in found.groupBy("build_id").count().collect()}
            if max(counts.values()) <= MERGE_MOST or sum(counts.values()) > 0.9 * last:
                break
            last = sum(counts.values())
            cells = {b: max(0, math.ceil(math.log2(c / MERGE_MOST)) + 1) for b, c in counts.items()}
            found = written(self._merge(found, WIDTHS[0], cells, skip, skip), f"spots-{skip}")
            skip += 3
        cells = {b: max(0, math.ceil(math.log2(c / MERGE_MOST))) for b, c in counts.items()}
        tried: list[dict[int, Mixture]] = []
        for w in WIDTHS:
            got: dict[int, list] = {}
            for r in self._merge(found, w, cells, skip, 99).filter(F.col("n") >= LEAST_ROWS).toLocalIterator():
                got.setdefault(r.build_id, []).append((r.n, np.frombuffer(r["mean"], "<f4"), np.frombuffer(r.square, "<f4")))
            tried.append({b: self._mixture(b, *(np.array(c) for c in zip(*rows))) for b, rows in got.items()})
        scores = [self._pass(m, False)[1] for m in tried]
        for b, s in self.spaces.items():
            best = [(self._bic(m[b], sc[b], s), i) for i, (m, sc) in enumerate(zip(tried, scores)) if b in m]
            if best:
                self.models[b] = tried[min(best)[1]][b]
        before: dict[int, float] = {}
        for _ in range(EM_ROUNDS):
            stats, fit = self._pass(self.models, True)
            for b in list(self.models):
                on = stats[b][0] >= 1
                if not on.any():  # all of it is background
                    del self.models[b]
                    continue
                n, s, q = joined(*(x[on] for x in stats[b]), self.spaces[b].rows)
                self.models[b] = self._mixture(b, n, s / np.maximum(n, 1)[:, None], q / np.maximum(n, 1)[:, None])
            if not self.models or before and all(fit[b] - before[b] < 1e-3 * self.spaces[b].rows for b in fit):
                break
            before = fit

    def _mixture(self, b: int, n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> Mixture:
        n, mean, square = n.astype("f8"), mean.astype("f8"), square.astype("f8")
        spread = np.maximum(square - mean**2, 0)
        big = n >= 2
        pooled = (n[big, None] * spread[big]).sum(0) / max(1.0, (n[big] - 1).sum()) if big.any() else self.spaces[b].var
        pooled = np.maximum(np.maximum(pooled, 0.05 * pooled[self.spaces[b].live].mean()), 1e-4) if self.spaces[b].live.any() else pooled + 1
        var = (n[:, None] * spread + PRIOR_ROWS * pooled) / (n[:, None] + PRIOR_ROWS)
        var[:, ~self.spaces[b].live] = BROAD  # as the background
        total = self.spaces[b].rows
        return Mixture(n / total, mean.astype("f4"), var.astype("f4"), max(1 / total, 1 - n.sum() / total))

    @staticmethod
    def _bic(m: Mixture, likelihood: float, space: Space) -> float:
        return -2 * likelihood + len(m.weight) * (2 * m.mean.shape[1] + 1) * math.log(max(space.rows, 2))

    def _shared(self, models: dict[int, Mixture]):
        size = sum(m.mean.nbytes + m.var.nbytes for m in models.values())
        if size > 4 * BROADCAST_LIMIT:
            raise ValueError(f"mixtures of {size >> 20} MB; fit fewer builds at once")
        return self.spark.sparkContext.broadcast((models, self.spaces))

    def _pass(self, models: dict[int, Mixture], update: bool) -> tuple[dict[int, tuple], dict[int, float]]:
        """One expectation step over all rows: ({build: (n, sums, sums of squares)}, {build: log-likelihood})."""
        shared, dim = self._shared(models), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, spaces = shared.value
            like: dict[int, float] = {}
            acc: dict[int, np.ndarray] = {}
            for b, _, x in _raw(batches, dim):
                if b not in models:
                    continue
                m, z = models[b], spaces[b](x)
                lp, bg = m.log_density(z, spaces[b])
                top = np.maximum(lp.max(1), bg)
                r, c = np.nonzero(lp > top[:, None] - 20)
                w = np.exp(lp[r, c] - top[r], dtype="f8")
                total = np.bincount(r, w, len(z)) + np.exp(bg - top)
                like[b] = like.get(b, 0.0) + float((np.log(total) + top).sum())
                if update and len(r):
                    zz = np.concatenate([z, z * z], 1)
                    names, n, s = _sum_rows(c, w / total[r], zz[r])
                    a = acc.setdefault(b, np.zeros((len(m.weight), 1 + zz.shape[1]), "f4"))
                    a[names, 0] += n
                    a[names, 1:] += s
            for b, v in like.items():
                rows = acc[b] if b in acc else np.zeros((0, 1), "f4")
                on = np.flatnonzero(rows[:, 0] > 1e-6) if len(rows) else np.zeros(0, "i8")
                k = np.append(-1, on)
                blobs = [np.array([v], "f8").tobytes(), *(rows[i].tobytes() for i in on)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b)), pa.array(k), pa.array(blobs, pa.binary())], names=["build_id", "k", "s"])

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for build, k, s in zip(*(b.column(c).to_pylist() for c in ("build_id", "k", "s"))):
                    v = np.frombuffer(s, "f8" if k < 0 else "f4").astype("f8")
                    total[build, k] = total[build, k] + v if (build, k) in total else v
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in total]), pa.array([k for _, k in total]), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["build_id", "k", "s"]
                )

        schema = "build_id long, k long, s binary"
        parts = self.rows.mapInArrow(run, schema).repartition("build_id", "k").mapInArrow(reduce, schema)
        like, stats = {}, {}
        for r in parts.toLocalIterator():
            v = np.frombuffer(r.s, "f8")
            if r.k < 0:
                like[r.build_id] = float(v[0])
            else:
                m = models[r.build_id]
                q = m.mean.shape[1]
                n, s, sq = stats.setdefault(r.build_id, (np.zeros(len(m.weight)), np.zeros((len(m.weight), q)), np.zeros((len(m.weight), q))))
                n[r.k], s[r.k], sq[r.k] = v[0], v[1 : 1 + q], v[1 + q :]
        for b, m in models.items():
            q = m.mean.shape[1]
            stats.setdefault(b, (np.zeros(len(m.weight)), np.zeros((len(m.weight), q)), np.zeros((len(m.weight), q))))
        return stats, like

    def _labelled(self, means: dict[int, np.ndarray] | None, least: float):
        """Function of raw batches: (build, ids, vectors, component, log density) of the rows kept. Without means those
        that are not background, with means those whose cosine with their component's mean is at least `least`."""
        shared, dim = self._shared(self.models), self.dim
        centre = self.spark.sparkContext.broadcast(means)
        same = self.spark.sparkContext.broadcast(self.same)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            models, spaces = shared.value
            for b, ids, x in _raw(batches, dim):
                if b not in models or not len(models[b].weight):
                    continue
                lp, bg = models[b].log_density(spaces[b](x), spaces[b])
                k = lp.argmax(1)
                d = lp[np.arange(len(x)), k]
                k = same.value[b][k] if b in same.value else k
                if centre.value is None:
                    good = d > bg
                else:
                    c = centre.value[b][k]
                    x8 = x.astype("f8")
                    good = (x8 * c).sum(1) >= least * np.sqrt(np.square(x8).sum(1) * np.square(c).sum(1))
                    good &= np.square(c).sum(1) > 0
                if good.any():
                    yield b, ids[good], x[good], k[good], d[good].astype("f8")

        return run

    def _means(self, means: dict[int, np.ndarray] | None, least: float) -> dict[int, np.ndarray]:
        label, dim = self._labelled(means, least), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b, _, x, k, _ in label(batches):
                names, n, s = _sum_rows(k, np.ones(len(k)), x.astype("f8"))
                for name, row in zip(names, np.concatenate([n[:, None], s], 1)):
                    total[b, int(name)] = total.get((b, int(name)), 0) + row
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in total]), pa.array([k for _, k in total]), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["build_id", "k", "s"]
                )

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for build, k, s in zip(*(b.column(c).to_pylist() for c in ("build_id", "k", "s"))):
                    total[build, k] = total.get((build, k), 0) + np.frombuffer(s, "f8")
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in total]), pa.array([k for _, k in total]), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["build_id", "k", "s"]
                )

        schema = "build_id long, k long, s binary"
        out = {b: np.zeros((len(m.weight), dim)) for b, m in self.models.items()}
        for r in self.rows.mapInArrow(run, schema).repartition("build_id", "k").mapInArrow(reduce, schema).toLocalIterator():
            v = np.frombuffer(r.s, "f8")
            out[r.build_id][r.k] = v[1:] / v[0]  # of a component that is part of another, zero stays
        return out

    def members(self, least: float) -> DataFrame:
        """(build_id, k, id, density) of the rows whose cosine with the mean of their component's rows is at least
        `least`; the mean is that of the rows kept the time before."""
        schema = "build_id long, k long, id long, density double"
        if not self.models:
            return self.spark.createDataFrame([], schema)
        means = self._means(None, least)
        # rows loaded several times make clumps that can pass for components; their mean lies in the group's range
        self.same = {b: one_mean(m, self.models[b].weight, least) for b, m in means.items()}
        if any((of != np.arange(len(of))).any() for of in self.same.values()):
            means = self._means(None, least)
        means = self._means(means, least)
        label = self._labelled(means, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, ids, _, k, d in label(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b)), pa.array(k), pa.array(ids), pa.array(d)], names=["build_id", "k", "id", "density"])

        return self.rows.mapInArrow(run, schema)


def groups(vectors: DataFrame, dim: int, least_cosine: float = 0.7, least_size: int = 5) -> DataFrame:
    """(build_id, group_id, id, density, size): one row for every vector in a group of least_size or more; group_id is
    the group's smallest id. vectors: (id, build_id, vec), ids unique. Null ids, builds and unusable vectors have no
    part; equal vectors are members each. A build without groups gives no rows. Components that share rows' mean
    direction stay apart: the criterion has chosen their number."""
    got = Fit(vectors, dim).members(least_cosine)
    got = written(got, "members")
    size = got.groupBy("build_id", "k").agg(F.min("id").alias("group_id"), F.count("*").alias("size")).filter(F.col("size") >= least_size)
    return got.join(size, ["build_id", "k"]).select("build_id", "group_id", "id", "density", "size")


def described(grouped: DataFrame, typical: int = 3) -> DataFrame:
    """(build_id, group_id, size, rank, id): the most typical members of each group, those of greatest density, of
    equal ones the smallest id."""
    w = Window.partitionBy("build_id", "group_id").orderBy(F.desc("density"), "id")
    top = grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    return top.select("build_id", "group_id", "size", "rank", "id")
