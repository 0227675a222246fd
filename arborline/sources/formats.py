"""Archives, matrices and byte stores as data sources that spark.read.format finds.

A partition is one archive, or one run of rows of a file; filters on `shard` (a file's name up to its
first dot) drop partitions before anything is read, and columns that the schema of a read leaves out
are not made.  Register them with register(spark).
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import tarfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .bytestore import read_exactly
from .files import CHUNK_BYTES, opened

#: Bytes of a batch of members.
BATCH_BYTES = 16 << 20


@dataclass
class Run(InputPartition):
    """A file, or n rows of it from `first`."""

    uri: str
    first: int = 0
    n: int = 0
    skip: int = 0
    dtype: str = ""


def files_of(pattern: str) -> list[tuple[str, int]]:
    """(uri, length) of the files that a glob over one folder's names fits, in order."""
    store, path = opened(pattern)
    scheme = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else re.match(r"^[a-z0-9+.-]+:/*(?=/)", pattern)[0]
    info = store.get_file_info(path)
    if info.is_file:
        return [(f"{scheme}{info.path}", info.size)]
    # A glob in folders: the last folder without one is listed.
    base = path if info.type == fs.FileType.Directory else re.split(r"[^/]*[*?\[]", path, maxsplit=1)[0].rstrip("/")
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    keep = [f for f in found if f.is_file and not posixpath.basename(f.path).startswith((".", "_"))]
    if base != path:
        deep = path.count("/")
        keep = [f for f in keep if f.path.count("/") == deep and fnmatch.fnmatchcase(f.path, path)]
    return sorted((f"{scheme}{f.path}", f.size) for f in keep)


def shard_of(uri: str) -> str:
    return posixpath.basename(uri).split(".", 1)[0]


class _Reader(DataSourceReader):
    """Runs of the files, without the shards that filters exclude."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.only = options, names, None

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("shard",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def runs_of(self, uri: str, length: int) -> list[Run]:
        return [Run(uri)]

    def partitions(self) -> list[Run]:
        files = [f for f in files_of(self.options["path"]) if self.only is None or shard_of(f[0]) in self.only]
        with ThreadPoolExecutor(16) as pool:
            return [r for runs in pool.map(lambda f: self.runs_of(*f), files) for r in runs] or [Run("")]

    def batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


#: Columns by their types.
TYPES = {"path": T.StringType(), "shard": T.StringType(), "row": T.LongType(), "data": T.BinaryType(), "v": T.ArrayType(T.DoubleType()), "name": T.StringType(), "error": T.StringType(), "key": T.StringType(), "jpg": T.BinaryType(), "txt": T.StringType()}


class _Source(DataSource):
    columns: tuple[str, ...] = ()
    reader_kind: type[_Reader] = _Reader

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[c]) for c in self.columns])

    def reader(self, schema: T.StructType) -> _Reader:
        for f in schema:
            if f.name not in self.columns or TYPES[f.name] != f.dataType:
                raise ValueError(f"{self.name()} has no column {f.name} {f.dataType.simpleString()}")
        if "path" not in self.options:
            raise ValueError(f"{self.name()} needs a path")
        return self.reader_kind(dict(self.options), schema.names)


class _Rows(_Reader):
    """Files of rows of one width."""

    def layout(self, uri: str) -> tuple[str, int, int]:
        """(dtype, bytes of a row, bytes before the first)."""
        return "", int(self.options["width"]), 0

    def runs_of(self, uri: str, length: int) -> list[Run]:
        dtype, width, skip = self.layout(uri)
        if (length - skip) % width:
            raise ValueError(f"short record in {uri}")
        rows, step = (length - skip) // width, max(1, int(self.options.get("chunkbytes", CHUNK_BYTES)) // width)
        return [Run(uri, first, min(step, rows - first), skip, dtype) for first in range(0, rows, step)]

    def column(self, run: Run, data: bytes) -> dict[str, pa.Array]:
        width = len(data) // run.n
        return {"data": pa.Array.from_buffers(pa.binary(width), run.n, [None, pa.py_buffer(data)]).cast(pa.binary())}

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.n:
            return
        out = {"path": pa.array([run.uri] * run.n), "shard": pa.array([shard_of(run.uri)] * run.n), "row": pa.array(range(run.first, run.first + run.n), pa.int64())}
        if set(self.names) - set(out):
            _, width, skip = self.layout(run.uri)
            store, path = opened(run.uri)
            with store.open_input_file(path) as f:
                out |= self.column(run, read_exactly(f, skip + run.first * width, run.n * width))
        yield self.batch(out)


class _Matrices(_Rows):
    def layout(self, uri: str) -> tuple[str, int, int]:
        from .matrices import header

        dtype, dim, skip = header(uri)
        return dtype.str, dtype.itemsize * dim, skip

    def column(self, run: Run, data: bytes) -> dict[str, pa.Array]:
        x = np.frombuffer(data, np.dtype(run.dtype)).astype(np.float64).reshape(run.n, -1)
        return {"v": pa.ListArray.from_arrays(pa.array(np.arange(run.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}


class _Members(_Reader):
    """Members of archives in passing; where one cannot be read further a row with the error ends it."""

    def members(self, uri: str, wanted: bool) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        try:
            store, name = opened(uri)
            with store.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m).read() if wanted else None, None
        except (tarfile.TarError, EOFError, OSError) as e:
            yield None, None, str(e)

    def rows(self, uri: str) -> Iterator[tuple]:
        yield from self.members(uri, "data" in self.names)

    fields = {"name": pa.string(), "data": pa.binary(), "error": pa.string()}

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            columns = {n: pa.array(v, t) for (n, t), v in zip(self.fields.items(), zip(*held, strict=True), strict=True)}
            return self.batch(columns | {"path": pa.array([run.uri] * len(held)), "shard": pa.array([shard_of(run.uri)] * len(held))})

        for row in self.rows(run.uri) if run.uri else ():
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
            if size >= BATCH_BYTES:
                yield made()
                held, size = [], 0
        if held:
            yield made()


class _Pairs(_Members):
    """Samples: neighbouring members of one name up to its last dot.  What lacks a part is left out, as is
    the rest of an archive that cannot be read further."""

    fields = {"key": pa.string(), "jpg": pa.binary(), "txt": pa.string()}

    def rows(self, uri: str) -> Iterator[tuple]:
        key, parts = None, {}
        for name, data, _ in self.members(uri, True):
            own, _, end = (name or "").rpartition(".")
            if own != key:
                if {"jpg", "txt"} <= parts.keys():
                    yield key, parts["jpg"], parts["txt"].decode("utf-8", "replace")
                key, parts = own, {}
            if name and own:
                parts[end] = data
        if {"jpg", "txt"} <= parts.keys():
            yield key, parts["jpg"], parts["txt"].decode("utf-8", "replace")


class ByteRows(_Source):
    """Option width: bytes of a row; chunkBytes: of a run."""

    columns, reader_kind = ("path", "shard", "row", "data"), _Rows

    @classmethod
    def name(cls) -> str:
        return "byte_rows"


class NpyRows(_Source):
    """Two-dimensional npy files in row order; v is an array of doubles."""

    columns, reader_kind = ("path", "shard", "row", "v"), _Matrices

    @classmethod
    def name(cls) -> str:
        return "npy_rows"


class TarMembers(_Source):
    columns, reader_kind = ("path", "shard", "name", "data", "error"), _Members

    @classmethod
    def name(cls) -> str:
        return "tar_members"


class TarPairs(_Source):
    columns, reader_kind = ("path", "shard", "key", "jpg", "txt"), _Pairs

    @classmethod
    def name(cls) -> str:
        return "tar_pairs"


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session, filters on shards included."""
    for kind in (ByteRows, NpyRows, TarMembers, TarPairs):
        spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A source by its name; schema: the columns to be made (all, if not given)."""
    reader = register(spark).read.format(kind).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)
