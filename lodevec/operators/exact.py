"""Exact regex-filtered nearest neighbours for a batch of queries.

A corpus is (id, str, vec), a query batch (qid, regex, qvec). Where both have a build_id, a query sees the rows of its
own build only; a query or row with a null build_id then sees nothing. All results are (qid, rank, id, dist), ordered by
distance, equal distances by id. Rows with a null id and queries with a null qid are left out, rows with a null str match nothing, rows whose vec is not usable have no distance
and never come out; a query with an invalid or null regex or an unusable qvec has no result. Empty tables give empty
results. Columns besides those named are ignored.

The corpus is read once for a block of queries. Each task keeps its own k best rows of a query, so what is shuffled is
at most k rows a query and task, whatever the corpus size; no query ever gathers its matches in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators import literals
from lodevec.plans import regexplan
from lodevec.session import BROADCAST_LIMIT


@dataclass(frozen=True)
class Query:
    qid: int
    regex: str
    vec: tuple[float, ...]
    build: int | None = None


def batch(queries: DataFrame, row_bytes: int = 0) -> Iterator[list[Query]]:
    """The query set in blocks that stay below the broadcast limit, one at a time; row_bytes is what a caller adds to
    each. Queries that cannot have a result are left out. Of a qid given more than once all rows count, as one query
    each would."""
    block, room = [], 0
    build = F.col("build_id") if "build_id" in queries.columns else F.lit(None)
    for r in queries.filter("qid is not null").select("qid", "regex", "qvec", build.alias("build")).toLocalIterator():
        v = r.qvec
        if v is None or any(x is None or np.isnan(x) for x in v) or not any(v) or not regexplan.valid(r.regex):
            continue
        size = 8 * len(v) + len(r.regex) + 64 + row_bytes
        if block and room + size > BROADCAST_LIMIT:
            yield block
            block, room = [], 0
        block.append(Query(r.qid, r.regex, tuple(v), r.build))
        room += size
    if block:
        yield block


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """In double precision, to one q or to that of each row; the sum runs in the same order for every row, so equal
    vectors get equal distances."""
    x = x.astype("f8")
    if metric == "l2":
        return np.sqrt(np.square(x - q).sum(1))
    dot = (x * q).sum(1)
    if metric == "ip":
        return -dot
    return 1 - dot / (np.sqrt(np.square(x).sum(1)) * np.sqrt(np.square(q).sum(-1)))


def _rough(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """[rows][queries] numbers that order as distances do, but for an error of about 1e-13 of their size, by one matrix
    product."""
    g = x @ q.T
    if metric == "l2":
        return np.square(x).sum(1)[:, None] + np.square(q).sum(1)[None] - 2 * g
    return -g if metric == "ip" else 1 - g / (np.sqrt(np.square(x).sum(1))[:, None] * np.sqrt(np.square(q).sum(1))[None])


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest by (d, id), in order."""
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return at[np.lexsort((ids[at], d[at]))[:k]]
    return np.lexsort((ids, d))


#: Patterns whose matches the JVM finds before rows go to Python, as bits of one number; of more, Python finds all.
MASK_BITS = 48


def mask_of(queries: list[Query], case_sensitive: bool = False) -> Column:
    """Bits of the patterns of a block that the row's str matches, null where there are too many patterns."""
    patterns = sorted({q.regex for q in queries})
    if len(patterns) > MASK_BITS:
        return F.lit(None).cast("long")
    bits = [F.when(F.col("str").rlike(regexplan.to_java(p, case_sensitive)), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(patterns)]
    return reduce(lambda a, b: a.bitwiseOR(b), [x.cast("long") for x in bits])


class Matches:
    """Match masks of one Arrow batch, each distinct pattern evaluated once."""

    def __init__(self, queries: list[Query], case_sensitive: bool) -> None:
        self.names = sorted({q.regex for q in queries})
        self.search = {p: regexplan.compiled(p, case_sensitive).search for p in self.names}

    def of(self, batch: pa.RecordBatch, at: np.ndarray | None = None) -> Matches:
        """Of a batch, or of its rows at these places: columns mask and str."""
        take = (lambda c: batch.column(c)) if at is None else (lambda c: batch.column(c).take(pa.array(at)))
        self.known: dict[str, np.ndarray] = {}
        self.mask = None
        if len(self.names) <= MASK_BITS and "mask" in batch.schema.names:
            self.mask = take("mask").fill_null(0).to_numpy()
        else:
            self.texts = take("str").to_pylist()
        return self

    def __call__(self, regex: str, among: np.ndarray | None = None) -> np.ndarray:
        """Positions that match; only those of among are looked at where it is given."""
        if self.mask is not None:
            bit = 1 << self.names.index(regex)
            return np.flatnonzero(self.mask & bit) if among is None else among[self.mask[among] & bit != 0]
        if among is not None:
            s, t = self.search[regex], self.texts
            return np.array([i for i in among if t[i] is not None and s(t[i])], "i8")
        if regex not in self.known:
            s = self.search[regex]
            self.known[regex] = np.array([i for i, t in enumerate(self.texts) if t is not None and s(t)], "i8")
        return self.known[regex]


_HITS = "qid long, id long, dist double, hit boolean"


def _local(queries: list[Query], keep: int | None, metric: str, filtered: bool, case_sensitive: bool, builds: bool, cells: list[np.ndarray] | None):
    """mapInArrow function. filtered: only matching rows compete; else all do, and hit says whether one matches.
    keep None: all rows come out. cells: of each query those whose rows compete."""
    dim = len(queries[0].vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Matches(queries, case_sensitive)
        vecs = np.array([q.vec for q in queries])
        best = [(np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "?")) for _ in queries]

        def out() -> Iterator[pa.RecordBatch]:
            for q, (d, ids, hit) in zip(queries, best):
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(d), q.qid)), pa.array(ids), pa.array(d), pa.array(hit)],
                        names=["qid", "id", "dist", "hit"],
                    )

        for b in batches:
            at, x = V.matrix(b.column("vec"), dim, "f8")
            if not len(at):
                continue
            place = pa.array(at)
            ids = b.column("id").take(place).to_numpy()
            matches = patterns.of(b, at)
            build = b.column("build").take(place).fill_null(-1).to_numpy() if builds else None
            cell = b.column("cell").take(place).fill_null(-1).to_numpy() if cells is not None else None
            strip = max(1, (1 << 22) // len(at))
            for k, q in enumerate(queries):
                if keep and k % strip == 0:
                    rough = _rough(x, vecs[k : k + strip], metric)
                rows = np.arange(len(at)) if cells is None else np.flatnonzero(np.isin(cell, cells[k]))
                if filtered:
                    rows = matches(q.regex) if cells is None else matches(q.regex, rows)
                if builds:
                    rows = rows[build[rows] == (-2 if q.build is None else q.build)]
                if keep and len(rows) > 2 * keep:
                    r = rough[rows, k % strip]
                    rows = rows[r <= np.partition(r, keep - 1)[keep - 1] + 1e-9 * (1 + np.abs(r).max())]
                if not len(rows):
                    continue
                d = distances(x[rows], vecs[k], metric)
                near = smallest(d, ids[rows], keep) if keep else np.arange(len(d))
                hit = np.ones(len(near), "?")
                if not filtered:
                    hit = np.zeros(len(at), "?")
                    hit[matches(q.regex, rows[near])] = True
                    hit = hit[rows[near]]
                new = (d[near], ids[rows[near]], hit)
                if keep:
                    new = tuple(np.concatenate(p) for p in zip(best[k], new))
                    cut = smallest(new[0], new[1], keep)
                    best[k] = tuple(p[cut] for p in new)
                else:
                    best[k] = new
            if not keep:
                yield from out()
                best = [(np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "?")) for _ in queries]
        if keep:
            yield from out()

    return run


def _many(queries: list[Query], keep: int, metric: str, case_sensitive: bool, builds: bool):
    """mapInArrow function, as _local with filtered and keep, for many patterns: queries of a build and pattern meet the
    rows that match it together, and of those only the ones near enough for a query are compared exactly."""
    vecs, qids = np.array([q.vec for q in queries], "f8"), np.array([q.qid for q in queries], "i8")
    dim = vecs.shape[1]
    asked: dict[int | None, dict[str, list[int]]] = {}
    for i, q in enumerate(queries):
        if not builds or q.build is not None:
            asked.setdefault(q.build if builds else None, {}).setdefault(q.regex, []).append(i)
    asked = {b: {p: np.array(m) for p, m in by.items()} for b, by in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[int | None, literals.Patterns] = {}
        best = [(np.zeros(0), np.zeros(0, "i8"))] * len(qids)
        far = np.full(len(qids), np.inf)  # the k-th distance of each query, as _rough has it

        def meet(x: np.ndarray, ids: np.ndarray, mine: np.ndarray) -> None:
            q = vecs[mine]
            rough = _rough(x, q, metric).T
            slack = 1e-9 * (1 + np.square(x).sum(1).max() + np.square(q).sum(1))
            limit = far[mine]
            if len(x) > 2 * keep and len(new := np.flatnonzero(np.isinf(limit))):
                limit[new] = np.partition(rough[new], keep - 1, axis=1)[:, keep - 1]
            near, row = np.nonzero(~(rough > (limit + slack)[:, None]))
            for part in range(0, len(near), strip := max(1, (1 << 21) // dim)):
                k, r = near[part : part + strip], row[part : part + strip]
                d = distances(x[r], q[k], metric)
                edge = np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(k))
                for a, b in zip(edge[:-1], edge[1:]):
                    i = mine[k[a]]
                    ds, got = np.append(best[i][0], d[a:b]), np.append(best[i][1], ids[r[a:b]])
                    cut = smallest(ds, got, keep)
                    best[i] = ds[cut], got[cut]
                    if len(cut) == keep:
                        far[i] = ds[cut[-1]] ** 2 if metric == "l2" else ds[cut[-1]]

        for b in literals.blocks(batches, max(1, (1 << 21) // dim)):
            at, x = V.matrix(b.column("vec"), dim, "f8")
            place = pa.array(at)
            ids, texts = b.column("id").take(place).to_numpy(), b.column("str").take(place)
            build = b.column("build").take(place).to_numpy() if builds else None
            for name, by in asked.items():
                rows = np.flatnonzero(build == name) if builds else np.arange(len(at))
                if not len(rows):
                    continue
                if name not in patterns:
                    patterns[name] = literals.Patterns(list(by), case_sensitive)
                block = patterns[name].block(texts.take(pa.array(rows)))
                for p, mine in enumerate(by.values()):
                    hit = rows[block.rows(p)]
                    if len(hit):
                        some, strip = x[hit], max(1, (1 << 21) // len(hit))
                        for i in range(0, len(mine), strip):
                            meet(some, ids[hit], mine[i : i + strip])
        size = max(1, (1 << 16) // keep)
        for i in range(0, len(best), size):
            some = best[i : i + size]
            n = [len(d) for d, _ in some]
            if sum(n):
                d, got = (np.concatenate(c) for c in zip(*some))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[i : i + size], n)), pa.array(got), pa.array(d), pa.array(np.ones(len(d), "?"))], names=["qid", "id", "dist", "hit"])

    return run


def cells_of(block: list[Query], cells: DataFrame, column: str = "cell") -> list[np.ndarray]:
    """Of each query of a block its cells; cells: (qid, cell). The caller has counted them into the block's size."""
    names = {q.qid for q in block}
    got: dict[int, list[int]] = {n: [] for n in names}
    mine = cells.join(F.broadcast(cells.sparkSession.createDataFrame([(n,) for n in names], "qid long")), "qid", "left_semi")
    for r in mine.select("qid", column).toLocalIterator():
        got[r.qid].append(r[column])
    return [np.array(sorted(got[q.qid]), "i8") for q in block]


def _scan(corpus: DataFrame, queries: DataFrame, keep: int | None, metric: str, filtered: bool, case_sensitive: bool, cells: DataFrame | None = None, cell_count: int = 0) -> DataFrame:
    """cells: (qid, cell) where a query sees only the rows of its cells; the corpus then has a column cell."""
    if metric not in V.METRICS:
        raise ValueError(f"metric is one of {sorted(V.METRICS)}")
    builds = "build_id" in corpus.columns and "build_id" in queries.columns
    build = F.col("build_id").cast("long") if builds else F.lit(None).cast("long")
    cell = F.col("cell").cast("long") if cells is not None else F.lit(None).cast("long")
    rows = corpus.filter("id is not null").select(F.col("id").cast("long").alias("id"), "str", F.col("vec").cast("array<float>").alias("vec"), build.alias("build"), cell.alias("cell"))
    out = corpus.sparkSession.createDataFrame([], _HITS)
    for whole in batch(queries, 8 * cell_count):
        for dim in sorted({len(q.vec) for q in whole}):
            block = [q for q in whole if len(q.vec) == dim]
            mine = None if cells is None else cells_of(block, cells)
            asked = rows
            if mine is not None:
                wanted = sorted({int(c) for a in mine for c in a})
                asked = rows.filter(F.col("cell").isin(wanted)) if len(wanted) <= 1000 else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in wanted], "cell long")), "cell", "left_semi")
            mask = mask_of(block, case_sensitive)
            if filtered and len({q.regex for q in block}) <= MASK_BITS:
                asked = asked.withColumn("mask", mask).filter("mask <> 0").drop("str")
            if filtered and keep and mine is None and len({q.regex for q in block}) > MASK_BITS:
                out = out.unionByName(asked.filter("str is not null and build is not null" if builds else "str is not null").mapInArrow(_many(block, keep, metric, case_sensitive, builds), _HITS))
                continue
            out = out.unionByName(asked.mapInArrow(_local(block, keep, metric, filtered, case_sensitive, builds, mine), _HITS))
    return out


def ranked(hits: DataFrame, k: int, by: str = "dist") -> DataFrame:
    """The k first rows of each qid by (by, id), as rank 1..k."""
    w = Window.partitionBy("qid").orderBy(by, "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _result(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "id", "dist")


def groundtruth(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", case_sensitive: bool = False) -> DataFrame:
    """The k nearest matching rows of every query by a full scan."""
    return _result(ranked(_scan(corpus, queries, k, metric, True, case_sensitive), k))


def in_cells(corpus: DataFrame, queries: DataFrame, cells: DataFrame, cell_count: int, k: int = 10) -> DataFrame:
    """The k nearest matching rows of every query among those of its cells. corpus has a column cell, cells (qid, cell)
    at most cell_count a query. Rows of cells that no query asks for are not read where the corpus is partitioned by
    cell; no pair of a query and a row is ever shuffled but the k nearest a task."""
    return _result(ranked(_scan(corpus, queries, k, "l2", True, False, cells, cell_count), k))


def prefilter(corpus: DataFrame, queries: DataFrame, k: int = 10, sample_ratio: float = 1.0, seed: int = 42, metric: str = "l2") -> DataFrame:
    """As groundtruth, over a sample of each query's n matches: the max(k, floor(n * sample_ratio)) of them that come
    first by a seeded hash of (qid, id). A ratio of 1 or more is exact.

    The size is met exactly without sorting a query's matches: hash prefixes are counted, whole prefixes below the cut
    are taken, and only the rows of the prefix on the cut are ranked.
    """
    if sample_ratio >= 1:
        return groundtruth(corpus, queries, k, metric)
    if sample_ratio < 0:
        raise ValueError("sample_ratio must not be negative")
    bits = 12
    h = F.xxhash64(F.lit(seed), "qid", "id")
    hits = _scan(corpus, queries, None, metric, True, False).withColumn("h", h).withColumn("bin", F.shiftrightunsigned("h", 64 - bits))
    bins = hits.groupBy("qid", "bin").agg(F.count("*").alias("n"))
    over = Window.partitionBy("qid").orderBy("bin")
    total = Window.partitionBy("qid")
    keep = F.greatest(F.lit(k), F.floor(F.sum("n").over(total) * sample_ratio))
    cut = (
        bins.withColumn("upto", F.sum("n").over(over)).withColumn("keep", keep)
        .filter(F.col("upto") - F.col("n") < F.col("keep"))
        .select("qid", "bin", F.when(F.col("upto") > F.col("keep"), F.col("keep") - F.col("upto") + F.col("n")).alias("part"))
    )
    rows = hits.join(cut, ["qid", "bin"])
    first = Window.partitionBy("qid", "bin").orderBy("h", "id")
    edge = rows.filter("part is not null").withColumn("r", F.row_number().over(first)).filter("r <= part")
    return _result(ranked(rows.filter("part is null").select("qid", "id", "dist").unionByName(edge.select("qid", "id", "dist")), k))


def postfilter(corpus: DataFrame, queries: DataFrame, k: int = 10, oversample: int = 10, max_expansion: int = 0, metric: str = "l2") -> DataFrame:
    """The first k matches among the k * max_expansion globally nearest rows; no limit where max_expansion is 0.

    oversample is the step by which a sequential engine would widen its window. It never changes the result, and here
    there is no window to widen; it is checked only. Without a limit the walk ends at the k nearest matches, which is
    what groundtruth computes.
    """
    if oversample < 1:
        raise ValueError("oversample must be 1 or more")
    if max_expansion <= 0:
        return groundtruth(corpus, queries, k, metric)
    hits = _scan(corpus, queries, k * max_expansion, metric, False, False)
    return _result(ranked(ranked(hits, k * max_expansion).filter("hit").drop("rank"), k))


def topk(corpus: DataFrame, regex: str, qvec: list[float], k: int = 10, metric: str = "l2", case_sensitive: bool = False) -> DataFrame:
    """One query as a plain expression: filter, distance, TakeOrderedAndProject. (id, dist), ordered."""
    if not regexplan.valid(regex):
        return corpus.sparkSession.createDataFrame([], "id long, dist double")
    q = F.array(*[F.lit(float(x)) for x in qvec])
    rows = corpus.filter(F.col("str").rlike(regexplan.to_java(regex, case_sensitive)) & V.usable(F.col("vec"), len(qvec)))
    return rows.select("id", V.METRICS[metric](F.col("vec"), q).alias("dist")).orderBy("dist", "id").limit(k)


#: Patterns counted as expressions of one projection; more of them are counted on Arrow batches, with the same result.
EXPRESSIONS = 32


def match_counts(corpus: DataFrame, patterns: dict[int, str], case_sensitive: bool = False) -> DataFrame:
    """(qid, matches) of every valid pattern, 0 included, in one pass over the texts. Null texts match nothing. Each
    distinct pattern is made ready once a task; many patterns are answered from where their words stand (literals)."""
    good = {q: p for q, p in patterns.items() if regexplan.valid(p)}
    spark = corpus.sparkSession
    if not good:
        return spark.createDataFrame([], "qid long, matches long")
    if len(good) <= EXPRESSIONS:
        counts = corpus.agg(*[F.count_if(F.col("str").rlike(regexplan.to_java(p, case_sensitive))).alias(f"m{q}") for q, p in good.items()])
        rows = F.array(*[F.struct(F.lit(q).cast("long").alias("qid"), F.col(f"m{q}").alias("matches")) for q in good])
        return counts.select(F.inline(rows))
    distinct = sorted(set(good.values()))
    at = {p: i for i, p in enumerate(distinct)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, n = literals.Patterns(distinct, case_sensitive), np.zeros(len(distinct), "i8")
        for b in literals.blocks(batches, 1 << 17):
            block = ready.block(b.column("str"))
            n += np.array([len(block.rows(i)) for i in range(len(n))], "i8")
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["p", "n"])

    per = corpus.select("str").filter("str is not null").mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("matches"))
    names = spark.createDataFrame([(q, at[p]) for q, p in good.items()], "qid long, p long")
    return names.join(F.broadcast(per), "p", "left").select("qid", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))
