"""The k nearest vectors of every vector by multi-index hashing over learned binary codes.

A rotation is learned for each build (principal directions, damped by their spread, then iterative quantisation) on a
bounded sample; signs after the rotation are a row's code. The code is cut into substrings, four and more the larger the
build, and each is an index of its own: rows with the same substring share a bucket. By the pigeonhole principle two
codes that differ in fewer than 4 * (flips + 1) bits share a substring but for at most `flips` bits, so probing a row's
own bucket in every index, and with flips = 1 those one bit away, retrieves all codes within that Hamming radius, and
many beyond it. What is retrieved is reranked by distance on the vectors.

Every row is indexed, in builds of any size. Vectors travel with 16 bits of mantissa, once for each index, and the error
of each; where rounding could change which k are nearest, and wherever distances are asked for, the stored vectors
decide in double precision. Buckets with more than BLOCK rows are cut to blocks whose pairs are separate units, and units
are spread over tasks by their cost. Of vectors that are equal bit by bit only the k + 1 smallest ids are indexed: no row
can have more of them as neighbours, and the nearest ones of the rest are known. Rows that meet fewer than k others in
all their buckets are scanned against all rows of their build, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.session import written

BLOCK = 16_384
#: Rows a build's rotation is learned on (about), and rows a bucket should hold at most, whatever the build's size.
SAMPLE, BUCKET_ROWS = 10_000, 8192
DAMP, ITQ_ROUNDS = 0.25, 30
#: Neighbours kept beyond the k-th of a list where rounding may have put them behind it.
EXTRA = 16
#: Pairs of rows that are about one task's work, and what a row itself counts as, so that a task's rows are bound too.
TASK_PAIRS, ROW_PAIRS = 3e8, 3000


def substring_bits(n: int) -> int:
    """Bits of a substring for a build of n rows: a third of the bits that would number the rows, which leaves buckets
    enough rows for the recall wanted, and from about a million rows on so many that buckets keep their size."""
    return min(20, max(1, round(math.log2(max(n, 2)) / 3), math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))))


def tables(n: int) -> int:
    """Substrings for a build of n rows: longer substrings miss more neighbours each, which more of them make up for."""
    return 4 + max(0, math.ceil((math.log2(max(n, 2)) - 17) / 2))


def places(t: int, bits: int, length: int) -> np.ndarray:
    """Bits of substring t of a code: the next ones, and where the code has no more a fixed choice of them."""
    if (t + 1) * bits <= length:
        return np.arange(t * bits, (t + 1) * bits)
    return np.sort(np.random.default_rng(t).choice(length, min(bits, length), replace=False))


def learn(x: np.ndarray, bits: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation): the code of v is the signs of (v - mean) @ rotation."""
    mean = x.mean(0)
    if len(x) < 2:
        return mean.astype("f4"), np.eye(x.shape[1], bits, dtype="f4")
    spread, axes = np.linalg.eigh(np.cov((x - mean).T))
    top = np.argsort(-spread)[:bits]
    axes = axes[:, top] * np.maximum(spread[top], 1e-12) ** (-DAMP / 2)
    y = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ITQ_ROUNDS):
        u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ vt).T
    return mean.astype("f4"), (axes @ r).astype("f4")


def shrink(x: np.ndarray) -> np.ndarray:
    """[n][3][dim] bytes: the upper three bytes of every value, rounded, in planes."""
    u = x.astype("<f4").view("<u4")
    u = u + np.uint32(0x80)
    b = np.ascontiguousarray(u).view("u1").reshape(len(x), -1, 4)
    return np.ascontiguousarray(b[:, :, 1:].transpose(0, 2, 1))


def restore(b: np.ndarray) -> np.ndarray:
    n, _, dim = b.shape
    full = np.zeros((n, dim, 4), "u1")
    full[:, :, 1:] = b.transpose(0, 2, 1)
    return full.reshape(n, dim * 4).view("<f4")


def nearest(a: np.ndarray, ai: np.ndarray, x: np.ndarray, xi: np.ndarray, k: int, margin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in a, id, squared distance) of the k nearest rows of x for each row of a, by (distance, id); a row is
    not its own neighbour. The fast float32 form picks all that can be among the k, double precision orders them. margin:
    for each row of a, up to EXTRA more come out that are further than the k-th by no more than it."""
    out = ([], [], [])
    margin = np.zeros(len(a)) if margin is None else margin
    if not len(a) or not len(x):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    order = np.argsort(xi)
    x, xi = x[order], xi[order]
    x2 = np.einsum("ij,ij->i", x, x)
    slack = np.float32(4e-6 * (x2.max() + np.einsum("ij,ij->i", a, a).max()))
    xt = np.ascontiguousarray(x.T)
    group = 32 if len(x) >= 32 * 4 * (k + 1) else 1
    own = np.searchsorted(xi, ai)
    own = np.where((own < len(xi)) & (xi[np.minimum(own, len(xi) - 1)] == ai), own, -1)
    strip = max(1, min(512, (1 << 23) // len(x)))
    for s in range(0, len(a), strip):
        q = a[s : s + strip]
        d = x2[None] - 2 * (q @ xt)
        me = own[s : s + strip]
        rows = np.flatnonzero(me >= 0)
        d[rows, me[rows]] = np.inf
        if len(x) > k:
            whole = len(x) // group * group
            low = d[:, :whole].reshape(len(q), -1, group).min(2) if group > 1 else d
            bound, q2, m = np.partition(low, k - 1, 1)[:, k - 1] + slack, np.einsum("ij,ij->i", q, q), margin[s : s + strip]
            bound = (np.sqrt(np.maximum(bound + q2, 0)) + m) ** 2 - q2 + slack if m.any() else bound
            r, c = np.nonzero(d <= bound[:, None])
        else:
            r, c = np.nonzero(d < np.inf)
        for t in range(0, len(r), 200_000):  # equal distances can make many
            rr, cc = r[t : t + 200_000], c[t : t + 200_000]
            e = np.square(q[rr].astype("f8") - x[cc]).sum(1)
            out[0].append(rr + s)
            out[1].append(xi[cc])
            out[2].append(e)
    row, near, dist = (np.concatenate(o) if o else np.zeros(0) for o in out)
    return _first(row.astype("i8"), near.astype("i8"), dist, k, margin)


def _first(row: np.ndarray, near: np.ndarray, dist: np.ndarray, k: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((near, dist, row))
    row, near, dist = row[order], near[order], dist[order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, "i8")
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    last = np.sqrt(dist[np.minimum(start + k, np.append(start[1:], len(row))) - 1]) if len(row) else np.zeros(0)
    keep = (rank < k) | (rank < k + EXTRA) & (np.sqrt(dist) <= (last + margin[row[start]]).repeat(np.diff(np.append(start, len(row)))))
    return row[keep], near[keep], dist[keep]


_BLOB = "task int, unit int, n int, blob binary"
#: err bounds what rounding adds to or takes from the distances of the list.
_NEAR = "id long, near array<struct<d: double, o: long>>, err double"


def _fit(pdf: pd.DataFrame, dim: int, bits: dict[int, int], count: dict[int, int]) -> pd.DataFrame:
    b = int(pdf.build_id.iloc[0])
    x = np.stack(pdf.sort_values("id").vec.values).astype("f8")
    mean, rotation = learn(x, min(dim, bits[b] * count[b]))
    return pd.DataFrame({"build_id": [b], "mean": [mean.tolist()], "rotation": [rotation.ravel().tolist()]})


class Router:
    """Buckets of rows: for each table the number of the bucket, build by build."""

    def __init__(self, dim: int, sizes: dict[int, int], models: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.dim, self.models, self.base, self.bits, self.tables, at = dim, models, {}, {}, {}, 0
        for b in sorted(sizes):
            self.bits[b] = substring_bits(sizes[b]) if b in models else 0
            self.base[b] = at
            self.tables[b] = tables(sizes[b]) if self.bits[b] else 1
            at += self.tables[b] << self.bits[b]
        self.buckets = at

    def __call__(self, build: np.ndarray, x: np.ndarray, flips: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, asks only): a row's bucket in each table and, with flips, those one bit away, where it asks."""
        rows, out, asks = [], [], []
        for b in np.unique(build):
            at = np.flatnonzero(build == b)
            s = self.bits[b]
            code = (x[at] - self.models[b][0]) @ self.models[b][1] > 0 if s else np.zeros((len(at), 0), "?")
            for t in range(self.tables[b]):
                sub = code[:, places(t, s, code.shape[1])]
                own = sub @ (1 << np.arange(sub.shape[1])) if s else np.zeros(len(at), "i8")
                for flip in [0, *((1 << np.arange(sub.shape[1])) if flips else ())]:
                    rows.append(at)
                    out.append(self.base[b] + (t << s) + (own ^ flip))
                    asks.append(np.full(len(at), flip > 0))
        return np.concatenate(rows), np.concatenate(out).astype("i8"), np.concatenate(asks)


def _block(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Block of an id in a bucket of so many blocks."""
    h = ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % blocks.astype("u8")).astype("i8")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, n = [], 0
    for b in batches:
        at, x = V.matrix(b.column("vec"), dim)
        if len(at):
            held.append((b.column("id").to_numpy()[at], b.column("build_id").to_numpy()[at], x))
            n += len(at)
        if n >= 40_000:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _pack(unit: np.ndarray, ids: np.ndarray, side: np.ndarray, x: np.ndarray, row: np.ndarray, task_of: np.ndarray) -> pa.RecordBatch:
    """Rows of each unit, packed column by column: id, error of rounding, side, rounded vector."""
    vec = shrink(x)
    err = np.sqrt(np.square(restore(vec).astype("f8") - x).sum(1)).astype("<f4") * np.float32(1.001)
    order = np.argsort(unit, kind="stable")
    unit, row, side = unit[order], row[order], side[order]
    start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    end = np.append(start[1:], len(unit))
    blobs = [b"".join((ids[row[a:b]].tobytes(), err[row[a:b]].tobytes(), side[a:b].astype("u1").tobytes(), vec[row[a:b]].tobytes())) for a, b in zip(start, end)]
    which = unit[start]
    return pa.RecordBatch.from_arrays(
        [pa.array(task_of[which].astype("i4")), pa.array(which.astype("i4")), pa.array((end - start).astype("i4")), pa.array(blobs, pa.binary())],
        names=["task", "unit", "n", "blob"],
    )


def _work(k: int, dim: int):
    """mapInArrow function over the blobs of whole tasks: of each row and unit the k nearest. side of a row: 0 both asks
    and answers in its unit; 1 and 2 are the two blocks of a pair, each asking the other; 3 asks only, 4 answers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for unit, n, blob in zip(*(batch.column(c).to_pylist() for c in ("unit", "n", "blob"))):
                vec = np.frombuffer(blob, "u1", offset=13 * n).reshape(n, 3, dim)
                held.setdefault(unit, []).append((np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<f4", n, 8 * n), np.frombuffer(blob, "u1", n, 12 * n), vec))
        for unit in sorted(held):
            ids, err, side, packed = (np.concatenate(c) for c in zip(*held.pop(unit)))
            x = restore(packed)
            for ask, answer in ((0, 0), (1, 2), (2, 1), (3, 0), (3, 4)):
                q, a = np.flatnonzero(side == ask), np.flatnonzero(side == answer)
                if len(q) and len(a):
                    row, near, d = nearest(x[q], ids[q], x[a], ids[a], k, 2.0 * (err[q] + err[a].max()))
                    if len(row):
                        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        items = pa.StructArray.from_arrays([pa.array(d), pa.array(near)], names=["d", "o"])
                        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype("i4")), items)
                        own = row[start]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q][own]), lists, pa.array((err[q][own] + err[a].max()).astype("f8"))], names=["id", "near", "err"])

    return run


def _spread(cost: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """(task of each unit, tasks): the costliest units first, each to the task with the least so far."""
    tasks = int(max(least, math.ceil(cost.sum() / TASK_PAIRS)))
    load = [(0.0, t) for t in range(tasks)]
    of = np.zeros(len(cost), "i8")
    for u in np.argsort(-cost, kind="stable"):
        done, t = heapq.heappop(load)
        of[u] = t
        heapq.heappush(load, (done + cost[u] + 1, t))
    return of, tasks


def _search(rows: DataFrame, dim: int, k: int, router: Router, flips: int) -> DataFrame:
    """(id, near, err) of each row and unit."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(router)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(router_buckets, "i8")
        for _, build, x in _chunks(batches, dim):
            n += np.bincount(shared.value(build, x)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    router_buckets = router.buckets
    size = np.zeros(router_buckets, "i8")
    for r in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        size[r.bucket] = r.n  # a bucket is thousands of rows
    blocks = np.maximum(1, -(-size // BLOCK))
    pairs = blocks * (blocks + 1) // 2
    first = np.cumsum(pairs) - pairs
    each = size / blocks
    probes = 1 + flips * max(router.bits.values(), default=0)
    cost = np.repeat(each * (each * probes + ROW_PAIRS), pairs)
    task_of, tasks = _spread(cost, spark.sparkContext.defaultParallelism)
    plan = spark.sparkContext.broadcast((blocks, first, task_of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first, task_of = plan.value
        for ids, build, x in _chunks(batches, dim):
            row, bucket, asks = shared.value(build, x, flips)
            nb = blocks[bucket]
            own = _block(ids[row], nb)
            each = np.repeat(np.arange(len(row)), nb)
            other = np.arange(len(each)) - np.repeat(np.cumsum(nb) - nb, nb)
            mine = np.where(asks[each], other, own[each])  # who asks only meets every block where that meets itself
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            unit = first[bucket[each]] + lo * nb[each] - lo * (lo - 1) // 2 + hi - lo
            side = np.where(asks[each], 3, np.where(lo == hi, 0, np.where(mine == lo, 1, 2)))
            yield _pack(unit, ids, side, x, row[each], task_of)

    return rows.mapInArrow(route, _BLOB).repartitionById(tasks, "task").mapInArrow(_work(k, dim), _NEAR)


def _scan(rows: DataFrame, asking: DataFrame, dim: int, k: int, sizes: dict[int, int]) -> DataFrame:
    """(id, near, err) of the asking rows against all rows of their build, in blocks."""
    blocks = {b: max(1, -(-n // (4 * BLOCK))) for b, n in sizes.items()}
    first, units = {}, 0
    for b in sorted(blocks):
        first[b] = units
        units += blocks[b]

    def route(batches: Iterator[pa.RecordBatch], ask: bool) -> Iterator[pa.RecordBatch]:
        for ids, build, x in _chunks(batches, dim):
            nb = np.array([blocks[b] for b in build])
            base = np.array([first[b] for b in build])
            row = np.repeat(np.arange(len(ids)), nb) if ask else np.arange(len(ids))
            unit = base[row] + np.arange(len(row)) - np.repeat(np.cumsum(nb) - nb, nb) if ask else base + _block(ids, nb)
            yield _pack(unit, ids, np.full(len(row), 3 if ask else 4), x, row, np.arange(units))

    both = rows.mapInArrow(partial(route, ask=False), _BLOB).unionByName(asking.mapInArrow(partial(route, ask=True), _BLOB))
    return both.repartitionById(units, "task").mapInArrow(_work(k, dim), _NEAR)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Lists of the same row joined to one of k, and those behind that rounding may have put there."""
    all_ = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.max("err").alias("err"))
    last = F.sqrt(F.get("near.d", F.lit(k - 1))) + 2 * F.col("err")
    return all_.select("id", F.filter("near", lambda n, i: (i < k) | (i < k + EXTRA) & (F.sqrt(n["d"]) <= last)).alias("near"))


def reranked(lists: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, near) of lists (id, near) by squared L2 distance of the stored vectors, in double precision."""
    pairs = lists.select("id", F.explode("near.o").alias("o"))
    pairs = pairs.join(rows.select(F.col("id").alias("o"), F.col("vec").alias("vo")), "o").join(rows.select("id", "vec"), "id")
    d = pairs.select("id", F.struct(V.squared_l2(F.col("vec"), F.col("vo")).alias("d"), "o").alias("n"))
    return d.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))


#: Parts an equal-vector class is spread to where its rows meet what is known of it.
SALTS = 32


def _salted(many: DataFrame) -> DataFrame:
    return many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def neighbours(vectors: DataFrame, dim: int, k: int = 5, flips: int = 0, distances: bool = True) -> DataFrame:
    """(id, near): near is the array of structs (d, o), the squared L2 distance and id of the up to k nearest other
    rows of the build found, by (d, o). vectors: (id, build_id, vec), ids unique. flips: bits of a substring that may
    differ in a probe, 0 or 1; 1 retrieves all codes within twice the radius, for about as many times the work as a
    substring has bits. Without distances only the k ids are those of the stored vectors, d and their order rounded.

    Rows with a null id or build_id or an unusable vec neither ask nor answer. A row alone in its build does not come
    out. Approximate: recall is measured against brute force in the tests.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("build_id").cast("long").alias("build_id"), F.col("vec").cast("array<float>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("build_id").isNotNull() & V.usable(F.col("vec"), dim))
    by = ["build_id", "h", "g"]
    tagged = rows.select("id", "build_id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(7), "vec").alias("g"))
    per = tagged.groupBy(*by).agg(F.count("*").alias("n"))
    sizes, many = {}, False
    for r in per.groupBy("build_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")).toLocalIterator():
        sizes[r.build_id], many = r.n, many or r.most > k + 1
    known = None
    if many:
        salted = tagged.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        same = salted.join(_salted(per.filter(F.col("n") > k + 1).drop("n")), [*by, "salt"])
        first = same.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("id"))).filter(F.col("r") <= k + 1)  # at most SALTS * (k + 1) a class
        kept = written(first.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("r") <= k + 1).drop("salt"), "equal-kept")
        rest = written(same.join(kept.select("id"), "id", "left_anti"), "equal-rest")
        lists = kept.filter(F.col("r") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.lit(0.0).alias("d"), F.col("id").alias("o")))).alias("near"))
        known = rest.join(_salted(lists), [*by, "salt"]).select("id", "near")
        rows = rows.join(rest.select("id"), "id", "left_anti")
    bits, models = {b: substring_bits(n) for b, n in sizes.items()}, {}
    step = {b: max(1, n // SAMPLE) for b, n in sizes.items()}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                every = np.array([step[x] for x in b.column("build_id").to_numpy()], "u8")
                h = (b.column("id").to_numpy().astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                yield b.filter(pa.array(h % every == 0))

    fit = partial(_fit, dim=dim, bits=bits, count={b: tables(n) for b, n in sizes.items()})
    part = rows.mapInArrow(sampled, "id long, build_id long, vec array<float>")
    for r in part.groupBy("build_id").applyInPandas(lambda pdf: fit(pdf), "build_id long, mean array<float>, rotation array<float>").toLocalIterator():
        models[r.build_id] = (np.array(r["mean"], "f4"), np.array(r.rotation, "f4").reshape(dim, -1))
    merged = written(_best(_search(rows, dim, k, Router(dim, sizes, models), flips), k), "near")
    want = {b: n for b, n in sizes.items() if n > 1}  # of builds of no more than k rows all are scanned
    if want:
        in_want = rows.filter(F.col("build_id").isin(sorted(want))) if len(want) < len(sizes) else rows
        asking = written(in_want.join(merged.filter(F.size("near") >= k).select("id"), "id", "left_anti"), "asking")
        if not asking.isEmpty():
            scanned = _best(_scan(in_want, asking, dim, k, want), k)
            merged = written(merged.join(asking.select("id"), "id", "left_anti").unionByName(scanned), "near-scanned")
    if distances:
        out = reranked(merged, rows, k)
    else:
        out = merged.filter(F.size("near") <= k).unionByName(reranked(merged.filter(F.size("near") > k), rows, k))
    return out if known is None else out.unionByName(known)


def near_pairs(vectors: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once: pairs of which one is among the other's k nearest."""
    pairs = neighbours(vectors, dim, k, distances=False).select("id", F.explode("near").alias("n")).select("id", F.col("n.o").alias("o"))
    return pairs.select(F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b")).distinct()
