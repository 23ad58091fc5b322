"""Occurrences and record frequency of every term, from compressed bitmaps of record ids.

Vertical layout: for a term and a run of 65,536 ids (a chunk) the ids are one container, sorted 16-bit offsets below
4,096 of them and a bitmap of 8 KB from there on, with a counter of occurrences beside it. Tasks build containers for
their own rows; containers of a term and chunk meet at one task and are united; the record frequency is the sum of the
cardinalities over the chunks. A frequent term has as many chunks as there are id ranges, so it is spread over tasks,
and no task sees more of it than the 8 KB of one chunk from each builder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.session import small, written

#: Rows a builder takes before it writes its containers out.
FLUSH_ROWS = 1_000_000
CHUNK_BITS, ARRAY_MOST, BITMAP_BYTES = 16, 4096, 8192
_POSTING = "build_id long, term string, chunk long, ids binary, occurrences long"
_PART = "build_id long, term string, items long, occurrences long"


def containers(low: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary array: a container for each group low[starts[i]:starts[i + 1]] of sorted distinct 16-bit offsets."""
    ends = np.append(starts[1:], len(low))
    sizes = ends - starts
    if (sizes < ARRAY_MOST).all():
        offsets = np.append(starts, len(low)).astype("i4") * 2
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.astype("<u2").tobytes())])
    return pa.array([pack(low[a:b]) for a, b in zip(starts, ends)], pa.binary())


def pack(low: np.ndarray) -> bytes:
    if len(low) < ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, "?")
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(ids: bytes) -> np.ndarray:
    if len(ids) == BITMAP_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(ids, "u1"), bitorder="little")).astype("i8")
    return np.frombuffer(ids, "<u2").astype("i8")


def _build(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Containers of the terms of a table (build_id, term, id), and under the null term those of all its ids."""
    term = table.column("term").combine_chunks().dictionary_encode()
    code = pc.fill_null(term.indices, -1).to_numpy(zero_copy_only=False).astype("i8")
    build, ids = table.column("build_id").to_numpy(), table.column("id").to_numpy()
    builds, b = np.unique(build, return_inverse=True)
    words = len(term.dictionary)
    key = b * (words + 1) + code + 1
    #: each row once under its term, and each id once under the null term of its build
    everyone = np.unique(np.stack([b * (words + 1), ids]), axis=1) if len(ids) < 1000 else _pairs(b * (words + 1), ids)
    named = code >= 0
    key, ids = np.concatenate([key[named], everyone[0]]), np.concatenate([ids[named], everyone[1]])
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new_id = np.ones(len(key), "?")
    new_id[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    first = np.flatnonzero(new_id)
    k, i = key[first], ids[first]
    chunk = i >> CHUNK_BITS
    group = np.ones(len(k), "?")
    group[1:] = (k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])
    starts = np.flatnonzero(group)
    rows = np.diff(np.append(first[starts], len(key)))
    which = k[starts] % (words + 1) - 1
    names = term.dictionary.take(pa.array(np.where(which < 0, None, which), pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(builds[k[starts] // (words + 1)].astype("i8")), names, pa.array(chunk[starts]), containers(i & 0xFFFF, starts), pa.array(rows)],
        names=["build_id", "term", "chunk", "ids", "occurrences"],
    )


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), "?")
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= FLUSH_ROWS:
            yield from _build(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield from _build(pa.Table.from_batches(held))


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (build_id, term, chunk): cardinality of each group's union. The last group of a batch waits,
    as one united container, for the next batch."""
    wait: tuple | None = None

    def emit(build: list, term: list, items: list, occ: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(build, pa.int64()), pa.array(term, pa.string()), pa.array(items, pa.int64()), pa.array(occ, pa.int64())],
            names=["build_id", "term", "items", "occurrences"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        build, chunk = batch.column("build_id").to_numpy(), batch.column("chunk").to_numpy()
        term, ids, occ = batch.column("term").to_pylist(), batch.column("ids").to_pylist(), batch.column("occurrences").to_numpy()
        out = ([], [], [], [])
        starts = [i for i in range(n) if not i or build[i] != build[i - 1] or chunk[i] != chunk[i - 1] or term[i] != term[i - 1]]
        for s, e in zip(starts, [*starts[1:], n]):
            key = (int(build[s]), term[s], int(chunk[s]))
            parts, total = ids[s:e], int(occ[s:e].sum())
            if wait is not None:
                if wait[0] == key:
                    parts, total = [*parts, wait[1]], total + wait[2]
                else:
                    for o, v in zip(out, (wait[0][0], wait[0][1], len(unpack(wait[1])), wait[2])):
                        o.append(v)
                wait = None
            if e == n:
                wait = (key, parts[0] if len(parts) == 1 else pack(np.unique(np.concatenate([unpack(p) for p in parts]))), total)
            else:
                items = _size(parts[0]) if len(parts) == 1 else len(np.unique(np.concatenate([unpack(p) for p in parts])))
                for o, v in zip(out, (key[0], key[1], items, total)):
                    o.append(v)
        if out[0]:
            yield emit(*out)
    if wait is not None:
        yield emit([wait[0][0]], [wait[0][1]], [_size(wait[1])], [wait[2]])


def _size(ids: bytes) -> int:
    return len(unpack(ids)) if len(ids) == BITMAP_BYTES else len(ids) // 2


def frequencies(rows: DataFrame) -> DataFrame:
    """(build_id, term, items, occurrences) over rows (build_id, term, id), each row one occurrence.

    items is the number of distinct ids. The row with a null term has the build's distinct ids in all its rows, those
    with a null term included; its occurrences mean nothing. Rows with a null build_id or id are left out. Repeated
    rows count as occurrences each time, as items once. Other columns are ignored.
    """
    plain = rows.select(F.col("build_id").cast("long").alias("build_id"), "term", F.col("id").cast("long").alias("id"))
    made = plain.filter("build_id is not null and id is not null").mapInArrow(_postings, _POSTING)
    by = ["build_id", "term", "chunk"]
    parts = made.repartition(*by).sortWithinPartitions(*by).mapInArrow(_unite, _PART)
    return parts.groupBy("build_id", "term").agg(F.sum("items").alias("items"), F.sum("occurrences").alias("occurrences"))


def words(items: DataFrame) -> DataFrame:
    """(build_id, term, id): runs of three or more a-z in the lower-cased text; one row with a null term for a text
    without any. Null texts give nothing."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))
    return items.filter("text is not null").select("build_id", "id", F.explode_outer(runs).alias("term"))


def grams(index: DataFrame) -> DataFrame:
    """(build_id, term, id): stored grams in lower case, nulls left out."""
    return index.filter("gram is not null").select("build_id", "id", F.lower("gram").alias("term"))


def marked(freq: DataFrame, rare_most: int, common_share: int) -> DataFrame:
    """freq with mark: rare with at most rare_most items, else common with at least 1/common_share of the build's."""
    freq = written(freq, "terms")  # read twice
    total = freq.filter("term is null").select("build_id", F.col("items").alias("total"))
    named = freq.filter("term is not null").join(small(total, 32), "build_id")
    mark = F.when(F.col("items") <= rare_most, "rare").when(F.col("items") * common_share >= F.col("total"), "common")
    return named.withColumn("mark", mark)
