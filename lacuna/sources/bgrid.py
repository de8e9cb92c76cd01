"""Binary grids: a little-endian header, then 32-bit numbers with the variables of a cell side by side.

Header: size in bytes (64 bits), then as 32 bits each the number of dimensions, the dimensions, the number of
variables, the kind of each (0 continuous, 1 categorical) and the encoding (0 float, 1 integer, 2 unsigned).
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a valid file, and the numpy types of the encodings in order.
MOST_BYTES, MOST_DIMENSIONS, MOST_VARIABLES = 1 << 30, 16, 4096
ENCODINGS = ("<f4", "<i4", "<u4")
CELLS = 1 << 18


class Malformed(ValueError):
    """A file that is no valid grid."""


def encode(values: np.ndarray, kinds: Sequence[int] | None = None, encoding: int = 0) -> bytes:
    """A grid (last axis: variables; other axes slowest first) as bytes."""
    dims, nv = values.shape[:-1][::-1], values.shape[-1]
    head = np.array([len(dims), *dims, nv, *(kinds or [0] * nv), encoding], "<u4").tobytes()
    body = np.ascontiguousarray(values, ENCODINGS[encoding]).tobytes()
    return np.array([8 + len(head) + len(body)], "<u8").tobytes() + head + body


def header(raw: bytes) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    """Dimensions, kinds, encoding and where the numbers begin; raises Malformed."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise Malformed(what)

    need(20 <= len(raw) <= MOST_BYTES, "size out of bounds")
    need(int(np.frombuffer(raw, "<u8", 1)[0]) == len(raw), "stated size differs")
    words = np.frombuffer(raw[8 : 8 + 4 * ((len(raw) - 8) // 4)], "<u4")
    nd = int(words[0])
    need(0 < nd <= MOST_DIMENSIONS and len(words) > nd + 1, "number of dimensions")
    dims = tuple(int(v) for v in words[1 : 1 + nd])
    nv = int(words[1 + nd])
    need(all(dims) and 0 < nv <= MOST_VARIABLES and len(words) > nd + nv + 2, "dimensions or number of variables")
    kinds, encoding = tuple(int(v) for v in words[2 + nd : 2 + nd + nv]), int(words[2 + nd + nv])
    need(set(kinds) <= {0, 1} and encoding < len(ENCODINGS), "kinds or encoding")
    start, count = 8 + 4 * (3 + nd + nv), nv
    for v in dims:
        count *= v
    need(start + 4 * count == len(raw), "number of values")
    return dims, kinds, encoding, start


def decode(raw: bytes) -> tuple[np.ndarray, tuple[int, ...], int]:
    """Values (slowest dimension first, variables last), kinds and encoding."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    dims, kinds, encoding, start = header(raw)
    return np.frombuffer(raw, ENCODINGS[encoding], offset=start).reshape(*dims[::-1], len(kinds)), kinds, encoding


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values, _, _ = decode(content.as_py())
            flat = values.reshape(-1, values.shape[-1]).astype(np.float64)
            for a in range(0, len(flat), CELLS):
                part = flat[a : a + CELLS]
                n, nv = part.shape
                v = pa.array(part.ravel(), mask=np.isnan(part.ravel()))
                arrays = [pa.array([path] * n), pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * nv + 1, nv), pa.int32()), v)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "cell", "v"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, cell, v): cells of all binary grids under a path, plain or gzipped; NaN is null. One task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows, "path string, cell long, v array<double>")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, dims, kinds, encoding) of all binary grids under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1):
                raw = content.as_py()
                out.append(header(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)[:3])
            arrays = [batch.column(0), pa.array([list(o[0]) for o in out], pa.list_(pa.int64())), pa.array([list(o[1]) for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "dims", "kinds", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, dims array<long>, kinds array<int>, encoding int")


def write(spark: SparkSession, folder: str, values: np.ndarray, kinds: Sequence[int] | None = None, encoding: int = 0, compressed: bool = False) -> str:
    """Write a grid under the digest of its content, through Hadoop's file systems; returns the digest."""
    raw = encode(values, kinds, encoding)
    digest = hashlib.sha256(raw).hexdigest()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{digest}.bgrid{'.gz' if compressed else ''}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{digest}.part")
    out = fs.create(part, True)
    out.write(bytearray(gzip.compress(raw, mtime=0) if compressed else raw))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)
    return digest


def cells_of(spark: SparkSession, values: np.ndarray, names: Sequence[str]) -> DataFrame:
    """cell, x, y(, z) and one column per variable from an array held by the driver (last axis: variables)."""
    dims = values.shape[:-1][::-1]
    flat = values.reshape(-1, values.shape[-1])
    t = {"cell": pa.array(np.arange(len(flat)))} | {n: pa.array(flat[:, i].astype(float), mask=np.isnan(flat[:, i].astype(float))) for i, n in enumerate(names)}
    df = spark.createDataFrame(pa.table(t))
    from ..functions.cells import coordinates

    return df.withColumns(dict(zip("xyz", coordinates(F.col("cell"), dims), strict=False)))
