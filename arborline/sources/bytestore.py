"""Fixed-width byte rows, tar members and metric logs as Spark data sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .files import CHUNK_BYTES, opened

NAME = r"^([0-9a-f]{32})\.jpg$"


def byte_rows(spark: SparkSession, path: str, width: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, shard, row, data): the rows of files of fixed-width records, read in runs of about `chunk_bytes`, so
    files may have any size; one whose size is no multiple of the width raises."""
    from .formats import read

    return read(spark, "byte_rows", path, width=str(width), chunkBytes=str(chunk_bytes))


#: Rows between two requested ones that are read rather than skipped, bytes of one read, and bytes of a
#: file that one task is asked for.
GAP_ROWS, RUN_BYTES, PART_BYTES = 8, 8 << 20, 64 << 20


def runs(rows: list[int], width: int, gap: int = GAP_ROWS, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of the reads that cover sorted rows: neighbours, and rows with a small gap between
    them, in one, of at most so many bytes."""
    first = last = None
    for row in rows:
        if first is not None and row - last <= gap + 1 and (row - first + 1) * width <= most:
            last = row
            continue
        if first is not None:
            yield first, last
        first = last = row
    if first is not None:
        yield first, last


def read_exactly(f, at: int, size: int) -> bytes:
    """So many bytes of an open file: a short read is followed by one of the rest; at its end that raises."""
    parts = []
    while size:
        got = f.read_at(size, at)
        if not got:
            raise EOFError(f"the file ends at {at}")
        parts.append(got)
        at, size = at + len(got), size - len(got)
    return b"".join(parts)


def read_positions(asked: DataFrame, folder: str, width: int, gap: int = GAP_ROWS, run_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES, counted=None, ending: str = ".u8") -> DataFrame:
    """(pos, shard, row, data) for each request (pos, shard, row), in the order of pos: positional reads of
    the files <shard, five digits><ending> of fixed-width rows.

    Requests go to tasks by parts of the files, are sorted in file order there, and neighbours are read at
    once; a row that is asked for several times is read once.  Only what is asked for, and gaps of at most
    `gap` rows, is read; a row beyond the end raises.  counted: an accumulator of the bytes read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_files: dict[int, object] = {}
        for b in batches:
            shard, row = b.column(1).to_numpy(), b.column(2).to_numpy()
            data: list[bytes | None] = [None] * b.num_rows
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(shard)) + 1) if b.num_rows else ():
                number = int(shard[own[0]])
                if number not in opened_files:
                    for f in opened_files.values():
                        f.close()
                    store, path = opened(f"{folder}/{number:05d}{ending}")
                    opened_files = {number: store.open_input_file(path)}
                at = 0
                for first, last in runs(np.unique(row[own]).tolist(), width, gap, run_bytes):
                    got = read_exactly(opened_files[number], first * width, (last - first + 1) * width)
                    if counted is not None:
                        counted.add(len(got))
                    while at < len(own) and row[own[at]] <= last:
                        start = (int(row[own[at]]) - first) * width
                        data[own[at]] = got[start : start + width]
                        at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=["pos", "shard", "row", "data"])
        for f in opened_files.values():
            f.close()

    part = F.floor(F.col("row") * width / part_bytes)
    asked = asked.select(F.col("pos").cast("long"), F.col("shard").cast("long"), F.col("row").cast("long"))
    got = asked.repartition("shard", part).sortWithinPartitions("shard", "row").mapInArrow(read, "pos long, shard long, row long, data binary")
    # Rows go straight to the partition of their place: a sort would read the files once more for its ranges.
    ends = asked.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    if ends["lo"] is None:
        return got
    parts = min(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ends["hi"] - ends["lo"] + 1)
    place = F.expr(f"(pos - {ends['lo']}) div {-(-(ends['hi'] - ends['lo'] + 1) // parts)}").cast("int")
    return got.repartitionById(parts, place).sortWithinPartitions("pos")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, shard, name, data, error) of the members of tar and tar.gz files, one partition each (gzip cannot
    be split); where an archive cannot be read further a row with the error ends it."""
    from .formats import read

    return read(spark, "tar_members", path)


def tar_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, jpg, txt): neighbouring members that share a name up to its ending; samples without both are left out."""
    from .formats import read

    return read(spark, "tar_pairs", path, "key string, jpg binary, txt string")


def valid_member(name: Column) -> Column:
    """The uuid of a member named <uuid>.jpg, else null."""
    return F.nullif(F.regexp_extract(name, NAME, 1), F.lit(""))


#: Bytes of a piece of a value, and pieces that are normalized at a time.
PIECE_BYTES, PIECES = 4096, 128


def normalized_bytes(rows: DataFrame, data: str, mean: float, std: float, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """rows with (piece, x) in place of a binary column: (byte / 255 - mean) / std of each byte of its pieces, numbered
    from 0.  A double takes eight times its byte, so values go in pieces, and a task holds `PIECES` of them
    as doubles, however long a value is.  Values that are null or empty have no piece."""
    others = [x for x in rows.columns if x != data]
    last = F.floor((F.octet_length(data) - 1) / piece_bytes)
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.substring(F.col(data), k * piece_bytes + 1, F.lit(piece_bytes)))
    pieces = rows.where(F.octet_length(data) > 0).select(*others, F.posexplode(cut).alias("piece", data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PIECES):
                part = b.slice(at, PIECES)
                found = part.column(part.num_columns - 1).to_pylist()
                x = (np.frombuffer(b"".join(found), np.uint8) / 255 - mean) / std
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=[*others, "piece", "x"])

    made = T.StructType([*pieces.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return pieces.mapInArrow(run, made)


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG by its header, None of anything else."""
    if not data:
        return None
    number = lambda a, b, order="big": int.from_bytes(data[a:b], order)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return number(16, 20), number(20, 24)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return number(6, 8, "little"), number(8, 10, "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return number(18, 22, "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's start
            return number(at + 7, at + 9), number(at + 5, at + 7)
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + number(at + 2, at + 4)
    return None


@pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]))
def image_dims(s: pd.Series) -> pd.DataFrame:
    """Width and height of images by their headers; nulls where there are none."""
    return pd.DataFrame([image_size(x) or (None, None) for x in s], columns=["w", "h"]).astype("Int32")
