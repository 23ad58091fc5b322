"""Near-duplicate records by fast similarity sketching, banding and exact verification.

A record is a set of tokens: the distinct trigrams of its text, or for a vector the cells it falls into under random
hyperplanes taken three at a time. A sketch has t coordinates. In rounds 0 to t-1 every token is hashed to one
coordinate and a value, in rounds t to 2t-1 every token is a candidate for one fixed coordinate, so all get filled; a
coordinate keeps the value of the earliest round, in it the smallest. Two sketches agree in a coordinate with the
probability of their Jaccard similarity, and the sketch is concentrated about it like sampling without replacement.

Bands of three coordinates are hashed to buckets, so many that a pair at the threshold itself shares none with a
probability of about 0.05 %. They come in PASSES independent sketches, one after another, and the records of a pass are
freed before the next. Into a bucket a record brings its id and a signature of 32 bytes. Of a text that is the parity
of its tokens hashed to 256 places: two of them differ in no more places than their sets do in tokens. Of a vector it is
its unit vector along 32 fixed orthogonal directions, a byte each: two of them lie no further apart than the vectors do,
but for rounding. So pairs that differ too much for the threshold are dropped there without losing any. What is left is
verified exactly on the texts or vectors.

Exact copies are one class each beforehand and only its smallest id is sketched, so a text that fills a third of all
rows costs one row. A bucket with more than RUN_MOST rows is cut to blocks, and each pair of blocks is shuffled to a
place of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.functions import vector as V
from lodevec.session import small, written

#: Independent sketches, coordinates a band, bands of a sketch: texts from Jaccard 0.6, vectors from cosine 0.98.
PASSES, BAND, TEXT_BANDS, VEC_BANDS = 2, 3, 16, 12
PLANES, PLANES_A_TOKEN = 256, 3
#: Bytes of a signature, and steps of one in a projected vector for a length of 1.
SIGNATURE, STEPS = 32, 254
#: Bytes of a record in a bucket: key in its partition, id, size of its set, signature.
RECORD = 4 + 8 + 2 + SIGNATURE
MIN_GRAMS = 12
RUN_MOST = 4096
_GRAM_CODES = 27**3


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype("u8")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1024)
def _round_hash(vocabulary: int, coords: int, i: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, value) of every token in round i; the value starts with the round."""
    h = _mix(np.arange(vocabulary, dtype="u8") + np.uint64((i + 1 + (seed << 20)) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    where = (h >> np.uint64(40)) % np.uint64(coords) if i < coords else np.full(vocabulary, i - coords, "u8")
    return where.astype("i8"), (np.uint64(i << 23) | (h & np.uint64((1 << 23) - 1))).astype("u4")


def sketch(row: np.ndarray, token: np.ndarray, n: int, vocabulary: int, coords: int, seed: int = 0) -> np.ndarray:
    """[n][coords] sketches; token[j] belongs to record row[j], rows ascending, each with at least one token."""
    empty = np.uint32(0xFFFFFFFF)
    s = np.full(n * coords, empty, "u4")
    for i in range(2 * coords):
        where, value = _round_hash(vocabulary, coords, i, seed)
        at, v = row * coords + where[token], value[token]
        open_ = s[at] >= np.uint32(i << 23)
        np.minimum.at(s, at[open_], v[open_])
        if i % 8 == 7 or i >= coords:
            left = (s.reshape(n, coords) == empty).any(1)
            if not left.any():
                break
            keep = left[row]
            row, token = row[keep], token[keep]
    return s.reshape(n, coords)


def gram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct trigrams of index-form texts (a-z and blanks), sorted."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, "u1")
    offsets = offsets - offsets[0]
    letter = np.where(data == 32, 0, data - 96).astype("i8")
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if len(letter) < 3:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    code = letter[:-2] * 729 + letter[1:-1] * 27 + letter[2:]
    key = np.sort((row[:-2] * _GRAM_CODES + code)[row[:-2] == row[2:]])
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key  # several times as fast as unique
    return key // _GRAM_CODES, key % _GRAM_CODES


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(12).normal(size=(dim, PLANES)).astype("f4")


@lru_cache(8)
def _directions(dim: int) -> np.ndarray:
    q = np.linalg.qr(np.random.default_rng(13).normal(size=(dim, dim)))[0][:, :SIGNATURE]
    return np.pad(q, ((0, 0), (0, SIGNATURE - q.shape[1]))).astype("f4")


def projected(x: np.ndarray) -> np.ndarray:
    """[n][SIGNATURE] bytes, signed: the unit vectors along fixed orthogonal directions."""
    unit = x / np.sqrt(np.square(x, dtype="f8").sum(1))[:, None]
    return np.clip(np.rint(STEPS * (unit.astype("f4") @ _directions(x.shape[1]))), -127, 127).astype("i1").view("u1")


def _keys(s: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """[n][bands] bucket keys of sketches."""
    bands = s.shape[1] // BAND
    out = np.empty((len(s), bands), "u8")
    for b in range(bands):
        h = _mix(salt + np.uint64(b + 1))
        for c in range(b * BAND, (b + 1) * BAND):
            h = _mix(h ^ s[:, c])
        out[:, b] = h
    return out


_BLOB = "part int, n int, blob binary"


def _emit(keys: np.ndarray, ids: np.ndarray, size: np.ndarray, sig: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each target partition, its records packed column by column: key, id, size, signature."""
    n, bands = keys.shape
    key, at = keys.ravel(), np.repeat(np.arange(n), bands)
    part = (key % np.uint64(parts)).astype("i4")
    order = np.argsort(part, kind="stable")
    key, at, part = key[order], at[order], part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(starts[1:], len(part))
    key, size = (key >> np.uint64(32)).astype("u4"), np.minimum(size, 65_535).astype("u2")
    blobs = [b"".join((key[a:b].tobytes(), ids[at[a:b]].tobytes(), size[at[a:b]].tobytes(), sig[at[a:b]].tobytes())) for a, b in zip(starts, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array((ends - starts).astype("i4")), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])


def parity(row: np.ndarray, token: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """[n][SIGNATURE] bytes: for each of 8 * SIGNATURE places, is the number of the record's tokens hashed there odd?"""
    place = (_mix(np.arange(vocabulary, dtype="u8") + np.uint64(0xABCD)) % np.uint64(8 * SIGNATURE)).astype("i8")
    odd = np.bincount(row * 8 * SIGNATURE + place[token], minlength=n * 8 * SIGNATURE) & 1
    return np.packbits(odd.astype("u1").reshape(n, -1), axis=1)


def _batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _text_sketches(parts: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batched(batches, 20_000):
            row, code = gram_codes(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
            size = np.bincount(row, minlength=t.num_rows)
            enough = size >= MIN_GRAMS
            good = np.flatnonzero(enough)
            if len(good):
                keep = enough[row]
                row, code = (np.cumsum(enough) - 1)[row[keep]], code[keep]
                s = sketch(row, code, len(good), _GRAM_CODES, BAND * TEXT_BANDS, seed)
                salt = _mix(t.column("build_id").to_numpy()[good].astype("u8") + np.uint64(seed << 41))
                yield from _emit(_keys(s, salt), t.column("id").to_numpy()[good], size[good], parity(row, code, len(good), _GRAM_CODES), parts)

    return run


def _vector_sketches(parts: int, dim: int, seed: int):
    each = PLANES // PASSES
    tokens = each // PLANES_A_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim)
        for t in _batched(batches, 20_000):
            at, x = V.matrix(t.column("embedding"), dim)
            if len(at):
                bits = x @ planes > 0
                own = bits[:, seed * each : seed * each + tokens * PLANES_A_TOKEN].reshape(len(at), tokens, PLANES_A_TOKEN)
                token = (np.arange(tokens) * (1 << PLANES_A_TOKEN) + own @ (1 << np.arange(PLANES_A_TOKEN))).ravel()
                s = sketch(np.repeat(np.arange(len(at)), tokens), token, len(at), tokens << PLANES_A_TOKEN, BAND * VEC_BANDS, seed)
                salt = _mix(t.column("build_id").to_numpy()[at].astype("u8") + np.uint64((seed << 41) + (1 << 40)))
                yield from _emit(_keys(s, salt), t.column("id").to_numpy()[at], np.zeros(len(at), "i8"), projected(x), parts)

    return run


_PAIR = "a long, b long, of int, block binary"
_MEET = 32  # rows of a bucket from which on all its pairs are looked at in one matrix


class Parities:
    """Texts of a few buckets by size of their set and parity signature; a pair may differ in `share` of both sizes."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, share: float) -> None:
        self.words, self.size, self.share = list(np.ascontiguousarray(sig.view("u8").T)), size.astype("f4"), np.float32(share)

    def _far(self, i: np.ndarray, j: np.ndarray, words: int = 4) -> np.ndarray:
        return sum(np.bitwise_count(w[i] ^ w[j]).astype("u2") for w in self.words[:words])

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (i, j) within the limit; half the signature sorts out most."""
        for words in (2, 4):
            good = self._far(i, j, words) <= self.share * (self.size[i] + self.size[j]) + 1e-3
            i, j = i[good], j[good]
        return i, j

    def meet(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
        far = np.bitwise_count(self.words[0][x, None] ^ self.words[0][None, y])
        far += np.bitwise_count(self.words[1][x, None] ^ self.words[1][None, y])
        i, j = np.nonzero(far <= self.share * (self.size[x, None] + self.size[None, y]) + 1e-3)
        return self.close(i + x.start, j + y.start)


class Projections:
    """Vectors of a few buckets by projection; a pair may lie as far apart as unit vectors of that cosine, and rounding."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, least: float) -> None:
        self.x = np.ascontiguousarray(sig).view("i1").astype("f4")
        self.x2 = np.square(self.x).sum(1)
        self.most = np.float32((STEPS * math.sqrt(max(0.0, 2 - 2 * least)) + math.sqrt(SIGNATURE) + 0.1) ** 2)

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.square(self.x[i] - self.x[j]).sum(1) <= self.most
        return i[good], j[good]

    def meet(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.x[x] @ self.x[y].T >= ((self.x2[x] - self.most) / 2)[:, None] + (self.x2[y] / 2)[None])
        return i + x.start, j + y.start


def _meet(rows: Parities | Projections, x: slice, y: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of a row of x and a row of y behind it, in strips, to bound memory."""
    step = max(1, (1 << 20) // max(1, y.stop - y.start))
    for s in range(x.start, x.stop, step):
        i, j = rows.meet(slice(s, min(s + step, x.stop)), slice(max(y.start, s + 1), y.stop))
        if x == y:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield i, j


#: Pairs of one partition held to drop those found in several of its buckets.
PAIRS_HELD = 1 << 20


def _pairs(ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The pairs (i, j) of places in ids, each once."""
    i, j = (np.concatenate(c) for c in zip(*found))
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, "?")
    a, b = a[new], b[new]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=["a", "b", "of", "block"])


def _opened(blob: bytes, n: int, keyed: bool = True) -> tuple[np.ndarray, ...]:
    """(key, ids, sizes, signatures) of packed records."""
    at, out = 0, []
    for kind, width in (("u4", 4), ("i8", 8), ("u2", 2))[0 if keyed else 1 :]:
        out.append(np.frombuffer(blob, kind, n, at))
        at += width * n
    return *out, np.frombuffer(blob, "u1", offset=at).reshape(n, -1)


def _buckets(near):
    """mapInArrow function over the blobs of whole target partitions: close pairs of each bucket. A bucket with more
    than RUN_MOST rows comes out as blocks: a is its partition and key, b the number of the block, of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for part, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "blob"))):
                held.setdefault(part, []).append(_opened(blob, n))
        for part in sorted(held):
            key, ids, size, sig = (np.concatenate(c) for c in zip(*held.pop(part)))
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(starts, len(key)))
            shared = np.repeat(n > 1, n)  # most records are alone in their bucket
            order, key = order[shared], key[shared]
            ids, size, sig = ids[order], size[order], sig[order]
            n = n[n > 1]
            starts = np.cumsum(n) - n
            for s, m in zip(starts[n > RUN_MOST], n[n > RUN_MOST]):
                blocks = -(-m // RUN_MOST)
                for k, i in enumerate(range(s, s + m, RUN_MOST)):
                    e = min(i + RUN_MOST, s + m)
                    blob = b"".join((ids[i:e].tobytes(), size[i:e].tobytes(), sig[i:e].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | int(key[s])]), pa.array([k]), pa.array([blocks], pa.int32()), pa.array([blob], pa.binary())], names=["a", "b", "of", "block"])
            rows, found, count = near(size, np.ascontiguousarray(sig)), [], 0

            def some() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for s, m in zip(starts[(n >= _MEET) & (n <= RUN_MOST)], n[(n >= _MEET) & (n <= RUN_MOST)]):
                    yield from _meet(rows, slice(s, s + m), slice(s, s + m))
                to_end = np.repeat(starts + n, n) - np.arange(len(key))
                at, step = np.flatnonzero(np.repeat(n < _MEET, n)), 1
                while len(at := at[to_end[at] > step]):
                    for i in range(0, len(at), 1 << 18):
                        yield rows.close(at[i : i + (1 << 18)], at[i : i + (1 << 18)] + step)
                    step += 1

            for i, j in some():
                found.append((i, j))
                count += len(i)
                if count > PAIRS_HELD:
                    yield _pairs(ids, found)
                    found, count = [], 0
            if count:
                yield _pairs(ids, found)

    return run


def _block_pairs(near):
    """mapInArrow function over rows (key, i, j, block) sorted by the first three: close pairs across the two blocks
    that meet at each (key, i, j), or within the one that meets itself."""

    def met(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, size, sig = (np.concatenate(c) for c in zip(*(_opened(b, len(b) // (RECORD - 4), False) for b in blobs)))
        n = len(blobs[0]) // (RECORD - 4)
        x, y = slice(0, n), slice(n, len(ids)) if len(blobs) > 1 else slice(0, n)
        for i, j in _meet(near(size, sig), x, y):
            yield _pairs(ids, [(i, j)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for *where, block in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "block"))):
                if held and where != now:
                    yield from met(held)
                    held = []
                now = where
                held.append(block)
        if held:
            yield from met(held)

    return run


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written_freed(df: DataFrame, name: str) -> DataFrame:
    """written(), with the shuffle files removed as soon as the table stands: bucket records are the most of the disk."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _candidates(sketched, parts: int, near, name: str) -> DataFrame:
    """(a, b) distinct, a < b, of equal build: pairs that share a bucket and have close signatures. sketched: the
    records of a pass by its number."""
    out = None
    for seed in range(PASSES):
        found = _written_freed(sketched(seed).repartitionById(parts, "part").mapInArrow(_buckets(near), _PAIR), f"{name}-{seed}")
        hot = found.filter("block is not null").select(F.col("a").alias("key"), "b", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o"))
        hot = hot.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "block")
        met = hot.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_pairs(near), _PAIR)
        both = found.filter("block is null").select("a", "b").unionByName(met.select("a", "b"))
        out = both if out is None else out.unionByName(both)
    return out.filter("a < b").distinct()


def classes(rows: DataFrame, value: F.Column, name: str) -> DataFrame:
    """(id, rep, n) of rows that are copies of another of their build: rep, the smallest of the n ids of equal values.
    Only values that occur more than once come out, their representatives included."""
    h = rows.select("id", "build_id", F.xxhash64(value).alias("h"), F.xxhash64(F.lit(7), value).alias("g"))
    twice = written(h.groupBy("build_id", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), f"{name}-twice")
    return h.join(small(twice, 64), ["build_id", "h", "g"]).select("id", "rep", "n")


#: Bytes of bucket records one task should hold.
TASK_BYTES = 96 << 20


def _parts(df: DataFrame, bands: int) -> int:
    """Target partitions: as configured, more where a task would hold too many records."""
    bytes_ = df.count() * bands * RECORD  # of one pass
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES))


def _with_reps(copies: DataFrame) -> DataFrame:
    """Ids of copies that are not their class's representative."""
    return small(copies.filter("id <> rep").select("id"), 32)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def text_links(items: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """((a, b) pairs of representatives, (id, rep) copies): items of a build with Jaccard similarity of at least
    `least` between their distinct trigrams, of which each has 12 or more. Null texts have no part, and copies of a
    text with fewer trigrams are none."""
    rows = items.filter("text is not null and build_id is not null and id is not null").select("id", "build_id", T.preprocess(F.col("text")).alias("text"))
    rows = rows.filter(F.length("text") >= MIN_GRAMS + 2)
    copies = written(classes(rows, F.col("text"), "text"), "text-copies")
    single = written(rows.join(_with_reps(copies), "id", "left_anti"), "texts")

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = np.bincount(gram_codes(batch.column("text"))[0], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(size >= MIN_GRAMS))], names=["rep"])

    reps = rows.join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text").mapInArrow(enough, "rep long")
    copies = copies.join(reps, "rep", "left_semi")
    parts = _parts(items, TEXT_BANDS)
    share = (1 - least) / (1 + least)  # of both sizes together, by which sets of Jaccard similarity `least` differ
    close = written(_candidates(lambda seed: single.mapInArrow(_text_sketches(parts, seed), _BLOB), parts, partial(Parities, share=share), "text-buckets"), "text-pairs")
    few = single.join(small(written(_ends(close), "text-ends"), 32), "id", "left_semi")
    pairs = close.join(few.select(F.col("id").alias("a"), F.col("build_id").alias("ba"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(few.select(F.col("id").alias("b"), F.col("build_id").alias("bb"), F.col("text").alias("tb")), "b").filter("ba = bb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            (ra, ca), (rb, cb) = gram_codes(batch.column("ta")), gram_codes(batch.column("tb"))
            both = np.sort(np.concatenate([ra * _GRAM_CODES + ca, rb * _GRAM_CODES + cb]))
            shared = both[:-1][both[1:] == both[:-1]] // _GRAM_CODES
            na, nb, ns = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n), np.bincount(shared, minlength=n)
            good = (np.minimum(na, nb) >= MIN_GRAMS) & (ns >= least * (na + nb - ns) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), copies


def vector_links(items: DataFrame, dim: int, least: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """((a, b) pairs of representatives, (id, rep) copies): items of a build whose usable embeddings have a cosine of at
    least `least`. The cosine is computed in double precision."""
    rows = items.filter("build_id is not null and id is not null").filter(V.usable(F.col("embedding"), dim))
    rows = rows.select("id", "build_id", F.col("embedding").cast("array<float>").alias("embedding"))
    copies = written(classes(rows, F.col("embedding"), "vector"), "vector-copies")
    single = rows.join(_with_reps(copies), "id", "left_anti")
    parts = _parts(items, VEC_BANDS)
    close = written(_candidates(lambda seed: single.mapInArrow(_vector_sketches(parts, dim, seed), _BLOB), parts, partial(Projections, least=least), "vector-buckets"), "vector-pairs")
    few = rows.join(small(written(_ends(close), "vector-ends"), 32), "id", "left_semi")
    pairs = close.join(few.select(F.col("id").alias("a"), F.col("build_id").alias("ba"), F.col("embedding").alias("ea")), "a")
    pairs = pairs.join(few.select(F.col("id").alias("b"), F.col("build_id").alias("bb"), F.col("embedding").alias("eb")), "b").filter("ba = bb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (V.matrix(batch.column(c), dim, "f8")[1] for c in ("ea", "eb"))
                cos = (a * b).sum(1) / np.sqrt(np.square(a).sum(1) * np.square(b).sum(1))
                good = pa.array(cos >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "ea", "eb").mapInArrow(verify, "a long, b long"), copies


#: Copies of one class that one task spreads to pairs.
CLASS_ROWS = 2000


def expanded(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links between representatives spread to all their copies, and pairs inside a class. A
    class meets itself in parts of about CLASS_ROWS copies, so its pairs come from as many tasks as they need."""
    left, right = copies.select(F.col("rep").alias("a"), F.col("id").alias("ia")), copies.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    full = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    parts = F.ceil(F.col("n") / CLASS_ROWS).cast("int")
    one = copies.select("rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    all_ = copies.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    inside = one.join(all_, ["rep", "part"]).filter("x < y").select("x", "y")
    return full.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_pairs(items: DataFrame, dim: int, jaccard: float = 0.6, cosine: float = 0.98) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once: items (id, build_id, text, embedding) of one build that are near by text or
    by embedding. Copies are expanded to pairs."""
    t_links, t_copies = text_links(items, jaccard)
    v_links, v_copies = vector_links(items, dim, cosine)
    return expanded(t_links, t_copies).unionByName(expanded(v_links, v_copies)).distinct()


def near_groups(items: DataFrame, dim: int, jaccard: float = 0.6, cosine: float = 0.98, most_rounds: int = 60) -> DataFrame:
    """(id, group_id, links) of the items with at least one near item: group_id is the smallest id reachable over links,
    links the number of distinct representatives or copies' representatives it is linked to directly.

    Labels travel along links until none changes; each round is written, so lineage stays short. Raises RuntimeError
    should most_rounds not be enough, rather than give split groups.
    """
    t_links, t_copies = text_links(items, jaccard)
    v_links, v_copies = vector_links(items, dim, cosine)
    one_way = t_links.unionByName(v_links)
    for copies in (t_copies, v_copies):
        one_way = one_way.unionByName(copies.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    links = written(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("links")), "labels-0")
    for k in range(most_rounds):
        seen = links.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(seen, "a").select("a", F.least("label", "other").alias("new"), "label", "links")
        jump = step.join(labels.select(F.col("a").alias("new"), F.col("label").alias("far")), "new", "left")
        new = written(jump.select("a", F.least("new", "far").alias("label"), "links", (F.least("new", "far") != F.col("label")).alias("moved")), f"labels-{k + 1}")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("group_id"), "links")
    raise RuntimeError("labels still move")
