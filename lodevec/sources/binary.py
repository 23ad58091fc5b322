"""Vector files: fvecs, bvecs, ivecs (each record a little-endian int32 dimension and its values) and fbin (int32
count, int32 dimension, values). Files are read by byte ranges that hold whole records, so a large file is many tasks
and no task holds it whole; ids are record positions, known from the offset."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"fvecs": ("<f4", 4), "bvecs": ("u1", 1), "ivecs": ("<i4", 4), "fbin": ("<f4", 4)}
#: Bytes one task reads.
SPLIT_BYTES = 64 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path names and its name there; without a scheme the machine's own."""
    parsed = urlparse(path)
    return (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _open(path: str):
    system, name = _system(path)
    return system.open_input_file(name)


def _files(path: str) -> list[str]:
    """The file itself, or the part files of a directory in order."""
    system, name = _system(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and not f.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{f}" for f in found]


def _length(path: str) -> int:
    with _open(path) as f:
        return f.size()


def _layout(path: str, fmt: str) -> tuple[int, int, int, int]:
    """(records, dimension, bytes of a record, offset of the first)."""
    item, total = _KINDS[fmt][1], _length(path)
    if not total:
        return 0, 0, 0, 0
    with _open(path) as f:
        head = f.read(8)
    if fmt == "fbin":
        n, dim = struct.unpack("<ii", head.ljust(8, b"\0"))
        size, start = dim * item, 8
        if dim <= 0 or total != start + n * size:
            raise ValueError(f"{path}: {total} bytes are not {n} vectors of dimension {dim}")
        return n, dim, size, start
    (dim,) = struct.unpack("<i", head[:4].ljust(4, b"\0"))
    size = 4 + dim * item
    if dim <= 0 or total % size:
        raise ValueError(f"{path}: {total} bytes are not whole records of dimension {dim}")
    return total // size, dim, size, 0


def read_vectors(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(id, vec) of a file, or of a directory's files one after another, with vec array<float>, array<int> for ivecs.
    Raises ValueError for an unknown format, a file that is no whole number of records, or (in the task that meets it) a
    record of another dimension. An empty file has no rows."""
    if fmt not in _KINDS:
        raise ValueError(f"fmt is one of {sorted(_KINDS)}")
    ranges, before = [], 0
    for file in _files(path):
        n, dim, size, start = _layout(file, fmt)
        step = max(1, SPLIT_BYTES // max(size, 1))
        ranges += [(file, before, first, min(step, n - first), dim, size, start) for first in range(0, n, step)]
        before += n
    kind = _KINDS[fmt][0]
    out = pa.int32() if fmt == "ivecs" else pa.float32()
    schema = f"id long, vec array<{'int' if fmt == 'ivecs' else 'float'}>"
    each = spark.createDataFrame(ranges, "file string, before long, first long, n long, dim int, size int, start int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before, first, count, dim, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with _open(file) as f:
                    f.seek(start + first * size)
                    raw = np.frombuffer(f.read(count * size), "u1").reshape(count, size)
                if fmt != "fbin":
                    if not (raw[:, :4].copy().view("<i4") == dim).all():
                        raise ValueError(f"{file}: a record's dimension is not {dim}")
                    raw = raw[:, 4:]
                x = np.ascontiguousarray(raw).view(kind)
                for i in range(0, count, 10_000):
                    part = x[i : i + 10_000]
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dim, dtype="i4")), pa.array(part.ravel()).cast(out))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + i, first + i + len(part)) + before), vec], names=["id", "vec"])

    return (each.repartitionByRange(len(ranges), "file", "first") if ranges else each).mapInArrow(run, schema)


def count_vectors(path: str, fmt: str) -> tuple[int, int]:
    """(records, dimension) from the sizes and first bytes of the files."""
    got = [_layout(f, fmt)[:2] for f in _files(path)]
    return sum(n for n, _ in got), max((dim for _, dim in got), default=0)


def write_vectors(rows: DataFrame, directory: str, fmt: str) -> int:
    """(id, vec) to part files in id order (part-00000.fvecs, ...), one a partition; the number of files. directory is a
    path or URI that all executors share; one of the machine's own raises ValueError off local mode. A part is written
    under another name and moved, so a repeated task leaves one whole file. fbin has its count in front and is written
    as one part of its own count each."""
    if fmt not in _KINDS:
        raise ValueError(f"fmt is one of {sorted(_KINDS)}")
    spark = rows.sparkSession
    if urlparse(directory).scheme == "" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{directory} may be another folder on each executor; give a URI")
    kind = _KINDS[fmt][0]
    system, where = _system(directory)
    system.create_dir(where, recursive=True)
    ordered = rows.select("id", "vec").orderBy("id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, where = _system(directory)
        temporary, held = f"{where}/.part-{part:05d}-{attempt}", []
        with system.open_output_stream(temporary) as f:
            for pdf in batches:
                for v in pdf.vec:
                    x = np.asarray(v).astype(kind).tobytes()
                    if fmt == "fbin":
                        held.append(x)
                    else:
                        f.write(struct.pack("<i", len(v)) + x)
            if held:
                f.write(struct.pack("<ii", len(held), len(held[0]) // 4) + b"".join(held))
        system.move(temporary, f"{where}/part-{part:05d}.{fmt}")
        yield pd.DataFrame({"part": [part]})

    return ordered.mapInPandas(run, "part int").count()
