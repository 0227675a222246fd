"""Sinks: sorted indexes, summaries, key lists, archives, byte stores, exports and state with checks."""

from __future__ import annotations

import hashlib
import io
import os
import posixpath
import re
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.bytestore import read_exactly
from ..sources.files import opened, write_file
from ..sources.readers import NULL


def resolved(path: str) -> tuple[str, str]:
    """(store, path) with dots and links away: links of local paths only, other stores have none."""
    store, rest = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*:(?://[^/]*)?))?(.*)", path, re.S).groups()
    if store in (None, "file:", "file://"):
        return "file://", os.path.realpath(rest)
    return store, posixpath.normpath(rest)


def guard(path: str, forbidden: str) -> str:
    """The path, unless it lies under a folder that must not be written, on any store."""
    (store, real), (other, outside) = resolved(path), resolved(forbidden)
    if store == other and (real == outside or real.startswith(outside.rstrip("/") + "/")):
        raise ValueError(f"{path} lies under {forbidden}")
    return path


def guarded(rows: DataFrame, col: str, forbidden: str, name: str = "allowed") -> DataFrame:
    """rows with a column that tells whether each path may be written."""
    def allowed(path: str) -> bool:
        try:
            return bool(guard(path, forbidden))
        except ValueError:
            return False

    @pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(allowed, na_action="ignore")

    return rows.withColumn(name, check(col))


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes in values are doubled; an empty value is a pair of quotes, a missing one NULL."""
    df.write.csv(path, header=True, nullValue=NULL, emptyValue='""', escape='"')


def write_index(df: DataFrame, path: str) -> None:
    """Sorted by (shard, row) within ranges, so that readers prune."""
    df.repartitionByRange("shard", "row").sortWithinPartitions("shard", "row").write.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)


def write_keys(df: DataFrame, col: str, path: str) -> str:
    """One sorted key file; returns its SHA-256.  Key lists are small: one task writes the file."""
    df.select(col).orderBy(col).coalesce(1).write.text(path, lineSep="\n")
    spark = df.sparkSession
    return spark.read.format("binaryFile").load(f"{path}/part-*").where("length > 0").select(F.sha2("content", 256).alias("d")).first()["d"]


def write_tars(rows: DataFrame, folder: str) -> DataFrame:
    """One tar.gz for each shard with <key>.jpg and <key>.txt of its rows; a null member is left out.
    Rows stream into their archive; returns (shard, path, n)."""

    def archive(rows: Iterator[tuple]) -> Iterator[bytes]:
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w|gz") as t:
            for key, jpg, txt in rows:
                for end, data in (("jpg", jpg), ("txt", txt)):
                    if data is not None:
                        info = tarfile.TarInfo(f"{key}.{end}")
                        info.size = len(data)
                        t.addfile(info, io.BytesIO(data))
                if buf.tell() > 1 << 20:
                    yield buf.getvalue()
                    buf.seek(0)
                    buf.truncate()
        yield buf.getvalue()

    src = rows.select(F.col("shard").cast("long").alias("shard"), "key", "jpg", "txt")
    return _by_shard(src, "key", lambda shard, found: write_file(folder, f"{shard:05d}.tar.gz", archive(found)))


def write_bytes(rows: DataFrame, folder: str, width: int, order: str = "page_id") -> DataFrame:
    """One file of fixed-width records for each shard, in the order of a column; (shard, path, n)."""

    def checked(found: Iterator[tuple]) -> Iterator[bytes]:
        for (data,) in found:
            if len(data) != width:
                raise ValueError("a record has another width")
            yield data

    src = rows.select(F.col("shard").cast("long").alias("shard"), F.col(order).alias("_order"), "data")
    return _by_shard(src, "_order", lambda shard, found: write_file(folder, f"{shard:05d}.u8", checked(row[1:] for row in found)))


#: Bytes of a file of a store in parts.
PART_BYTES = 16 << 20


def write_parts(rows: DataFrame, folder: str, width: int, make, keep: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """A store of records make(data) of `width` bytes from (shard, row, data), in files <shard>.<part>.u8 of as
    many rows as `part_bytes` hold; (shard, row, size, digest) of each record as it is read back.

    Only the sources are shuffled: a record is made where its file is written.  Without `keep` a file goes as
    soon as its rows are read back, so the disk holds as many parts as tasks run.  A shard's rows go from 0 without
    a gap; of several sources of one row the first counts.
    """
    each = max(1, part_bytes // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (shard, part), found in groupby(flat, key=lambda r: (r[0], r[1] // each)):
            n = 0

            def made(part=part, found=found):
                nonlocal n
                for _, row, data in found:
                    if row == part * each + n - 1:
                        continue
                    if row != part * each + n:
                        raise ValueError("a row of the store has no source")
                    record = make(data)
                    if len(record) != width:
                        raise ValueError("a record has another width")
                    n += 1
                    yield record

            # A file that goes again has a name of its own: another attempt of the task has another one.
            path = write_file(folder, f"{shard:05d}.{part:05d}{'' if keep else '.' + uuid.uuid4().hex}.u8", made())
            store, own = opened(path)
            try:
                with store.open_input_file(own) as f:
                    if f.size() != n * width:
                        raise ValueError(f"short record in {path}")
                    back = [hashlib.sha1(read_exactly(f, k * width, width)).hexdigest() for k in range(n)]
            finally:
                if not keep:
                    store.delete_file(own)
            places = pa.array(range(part * each, part * each + n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), places, pa.array([width] * n, pa.int64()), pa.array(back, pa.string())], names=["shard", "row", "size", "digest"])

    src = rows.select(F.col("shard").cast("long").alias("shard"), F.col("row").cast("long").alias("row"), "data")
    return src.repartition("shard", F.expr(f"row div {each}")).sortWithinPartitions("shard", "row").mapInArrow(run, "shard long, row long, size long, digest string")


def _by_shard(rows: DataFrame, order: str, write) -> DataFrame:
    """Each shard's rows in order, streamed through `write(shard, rows)`; done at once, (shard, path, n)."""
    from itertools import groupby

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, found in groupby(flat, key=lambda row: row[0]):
            n = 0

            def counted(found=found):
                nonlocal n
                for row in found:
                    n += 1
                    yield row[1:]

            path = write(shard, counted())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([n], pa.int64())], names=["shard", "path", "n"])

    done = rows.repartition("shard").sortWithinPartitions("shard", order).mapInArrow(run, "shard long, path string, n long").toArrow()  # one row for each shard
    return rows.sparkSession.createDataFrame(done.to_pylist(), "shard long, path string, n long")


def export_files(rows: DataFrame, folder: str) -> DataFrame:
    """(name, status) of rows (name, path, data) written as files under the folder: written, existing (a file
    of the same size stays), or mismatch (the path's last part is not the name's: nothing is written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for b in batches:
            status = []
            for name, path, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path is None or posixpath.basename(name) != posixpath.basename(path) or data is None:
                    status.append("mismatch")
                    continue
                about = store.get_file_info(f"{root}/{name}")
                if about.is_file and about.size == len(data):
                    status.append("existing")
                else:
                    at, _, last = name.rpartition("/")
                    write_file(f"{folder}/{at}" if at else folder, last, iter([data]))
                    status.append("written")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.string())], names=["name", "status"])

    return rows.select("name", "path", "data").mapInArrow(run, "name string, status string")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether the commit protocol has left its marker."""
    store, p = _file(spark, f"{path}/_SUCCESS")
    return store.exists(p)


def begin(spark: SparkSession, folder: str) -> None:
    """Take the markers of an earlier run away, before anything is written."""
    for name in ("done", "failed"):
        store, p = _file(spark, f"{folder}/_{name}")
        store.delete(p, False)


def mark(spark: SparkSession, folder: str, name: str, about: str = "") -> None:
    """Leave a marker (done or failed) with a text; it appears whole or not at all."""
    if name not in ("done", "failed"):
        raise ValueError(f"no marker is called {name}")
    write = f"{folder}/.{name}.tmp"
    store, p = _file(spark, write)
    with_text = store.create(p, True)
    with_text.write(bytearray(about.encode()))
    with_text.close()
    _, final = _file(spark, f"{folder}/_{name}")
    store.delete(final, False)
    if not store.rename(p, final):
        raise OSError(f"no marker could be left in {folder}")


def markers(spark: SparkSession, folder: str) -> dict[str, bool]:
    return {name: (lambda sp: sp[0].exists(sp[1]))(_file(spark, f"{folder}/_{name}")) for name in ("done", "failed")}


def key_hash(keys: DataFrame, col: str):
    """A digest of a set of keys that does not gather them: a sum of hashes and a count."""
    return keys.select(col).distinct().agg(F.sum(F.xxhash64(col).cast("decimal(38,0)")).cast("string").alias("h"), F.count("*").alias("n")).first()


def content_hash(df: DataFrame) -> str:
    """A digest of rows in any order: their number and the sums of two hashes."""
    cols = [F.col(c) for c in df.columns]
    big = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    r = df.agg(F.count("*").alias("n"), big(F.xxhash64(*cols)).alias("a"), big(F.hash(*cols)).alias("b")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots whose manifests are there, newest first."""
    store, folder = _file(spark, path)
    found = store.listStatus(folder) if store.exists(folder) else []
    return sorted((int(m[1]) for f in found if (m := re.fullmatch(r"manifest-(\d+)", f.getPath().getName()))), reverse=True)


def save_state(state: DataFrame, path: str, key: str | None = None, keep: int = 2, before_swap=None) -> int:
    """A snapshot of a state in a folder of its own, then its manifest, which appears whole or not at all;
    returns the version.  Until the manifest is there, readers see the version before.  Of older
    snapshots `keep` stay.  before_swap: called between the two, as a crash there would come."""
    import json

    spark = state.sparkSession
    known = versions(spark, path)
    version = known[0] + 1 if known else 1
    data = f"data-{version:08d}-{uuid.uuid4().hex}"
    h = key_hash(state, key) if key else None
    state.write.parquet(f"{path}/{data}")
    back = spark.read.schema(state.schema).parquet(f"{path}/{data}")
    about = {"data": data, "content": content_hash(back), "keys": f"{h['h']}:{h['n']}" if h else None, "schema": state.schema.json()}
    if before_swap is not None:
        before_swap()
    store, temporary = _file(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = store.create(temporary, True)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()
    _, final = _file(spark, f"{path}/manifest-{version:08d}")
    if not store.rename(temporary, final):  # another writer was first
        raise OSError(f"version {version} of {path} is there already")
    for old in known[keep:]:
        _, gone = _file(spark, f"{path}/manifest-{old:08d}")
        named = json.loads(_text(spark, gone.toString()))["data"]
        store.delete(gone, False)
        store.delete(_file(spark, f"{path}/{named}")[1], True)
    return version


def load_state(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The newest snapshot whose content agrees with its manifest.  A snapshot that is damaged or gone is passed
    over for the one before; a sound one for other keys raises, as does a folder without a sound one."""
    import json

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import types as T

    h = key_hash(keys, key) if keys is not None else None
    for version in versions(spark, path):
        try:
            about = json.loads(_text(spark, f"{path}/manifest-{version:08d}"))
            state = spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(f"{path}/{about['data']}")
            sound = content_hash(state) == about["content"]
        except (PySparkException, Py4JJavaError, ValueError, KeyError):
            continue
        if sound:
            if h is not None and about["keys"] != f"{h['h']}:{h['n']}":
                raise ValueError("the state is for other keys")
            return state
    raise FileNotFoundError(f"no sound state in {path}")


def upsert_state(rows: DataFrame, path: str, key: str) -> int:
    """A new snapshot: the last sound one with these rows in place of those of their keys."""
    spark = rows.sparkSession
    if versions(spark, path):
        old = load_state(spark, path)
        rows = old.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
    return save_state(rows, path, key)
