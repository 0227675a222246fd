"""Matrices as npy files: written by sorted ranges of a key, read in runs of rows."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import matrix_of
from .files import CHUNK_BYTES, opened, write_file

MAGIC = b"\x93NUMPY"


def header(uri: str) -> tuple[np.dtype, int, int]:
    """(dtype, columns, bytes before the data) of a two-dimensional npy file in row order."""
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        start = f.read(12)
        if start[:6] != MAGIC:
            raise ValueError(f"{uri} is no npy file")
        wide = start[6] > 1
        size = struct.unpack("<I", start[8:12])[0] if wide else struct.unpack("<H", start[8:10])[0]
        skip = (12 if wide else 10) + size
        about = ast.literal_eval(f.read_at(size, skip - size).decode("latin-1"))
    if about["fortran_order"] or len(about["shape"]) != 2:
        raise ValueError(f"{uri} holds no matrix in row order")
    return np.dtype(about["descr"]), about["shape"][1], skip


def write_npy(rows: DataFrame, key: str, vec: str, folder: str, dtype: str = "<f4") -> DataFrame:
    """One matrix file for each range of the key, its rows in the key's order, beside a file of the keys;
    returns (path, keys, n).  Ranges are those of a range partitioning."""
    kind = np.dtype(dtype)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, keys, found = TaskContext.get().partitionId(), [], []
        for b in batches:
            if b.num_rows:
                keys += b.column(0).to_pylist()
                found.append(matrix_of(b.column(1)).astype(kind))
        if found:
            n, d = sum(map(len, found)), found[0].shape[1]
            about = repr({"descr": kind.str, "fortran_order": False, "shape": (n, d)}).encode()
            about += b" " * (-(len(about) + 11) % 64) + b"\n"
            name = f"part-{part:05d}"
            path = write_file(folder, f"{name}.npy", iter([MAGIC + b"\x01\x00" + struct.pack("<H", len(about)) + about, *(x.tobytes() for x in found)]))
            ids = write_file(folder, f"{name}.ids.txt", (("\n".join(map(str, keys[lo : lo + 100_000])) + "\n").encode() for lo in range(0, n, 100_000)))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ids]), pa.array([n], pa.int64())], names=["path", "keys", "n"])

    return rows.select(key, F.col(vec).cast("array<double>").alias("v")).repartitionByRange(key).sortWithinPartitions(key).mapInArrow(pack, "path string, keys string, n long")


def read_npy(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, shard, row, v) of the matrices of a glob, in runs of rows; v is an array of doubles."""
    from .formats import read

    return read(spark, "npy_rows", path, chunkBytes=str(chunk_bytes))


def write_npz(rows: DataFrame, key: str, columns: dict[str, str], folder: str) -> DataFrame:
    """One npz archive for each range of the key, its rows in the key's order: an array for each column, of the
    type named; vectors make matrices.  Returns (path, n).  A task holds its range."""
    import io

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str, list] = {c: [] for c in columns}
        for b in batches:
            for i, (c, kind) in enumerate(columns.items()):
                if b.num_rows:
                    own = b.column(i)
                    found[c].append((matrix_of(own) if pa.types.is_list(own.type) else own.to_numpy(zero_copy_only=False)).astype(kind))
        n = sum(map(len, found[key]))
        if n:
            out = io.BytesIO()
            np.savez_compressed(out, **{c: np.concatenate(x) for c, x in found.items()})
            path = write_file(folder, f"part-{TaskContext.get().partitionId():05d}.npz", iter([out.getvalue()]))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return rows.select(*columns).repartitionByRange(key).sortWithinPartitions(key).mapInArrow(pack, "path string, n long")


def read_npz(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named arrays (by the types that they get) of the archives of a glob, side by side; a task reads an
    archive, and of it the arrays that are named."""
    import zipfile

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, at = opened(uri)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    arrays = {c: np.lib.format.read_array(z.open(f"{c}.npy"), allow_pickle=False) for c in columns}
                made = [pa.array(list(x.astype(np.float64))) if x.ndim > 1 else pa.array(x) for x in arrays.values()]
                yield pa.RecordBatch.from_arrays(made, names=[*columns])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(read, ", ".join(f"{c} {t}" for c, t in columns.items()))
