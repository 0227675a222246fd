"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each archive holds a dictionary built from a sample of its own records, stored in a leading
skippable frame (magic 0x184D2A5D, little-endian length, dictionary), then one Zstandard frame
for each record.  Archives are written to the shared folder under a name of their own for each
attempt, and only those that a finished task reports are read: a lost executor's half-written
files are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, materialize, new_path, remove, scratch_scope, tidied

MAGIC = 0x184D2A5D
#: Uncompressed payload bytes of an archive, at least one record each.
ARCHIVE_BYTES = 16 << 20
#: The dictionary's size, and how many bytes of the archive's records it is built from: records at
#: even steps, of each its first SAMPLE_PART bytes (a sample for training only; records are whole).
DICT_BYTES, SAMPLE_BYTES, SAMPLE_PART = 32 << 10, 2 << 20, 64 << 10
#: Bytes given to the decompressor at a time: a frame's end is found by reading it.
FEED_BYTES = 8 << 10
#: Ways in which the copies of a payload are spread, and archives that a reading task takes at most.
SALT, TASK_ARCHIVES = 16, 16
LEVEL = 3
DATE = b"2000-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A WARC/1.1 response record, or a revisit record without payload where refers_to is given."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % ("" if page_id is None else str(page_id)).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + (url or "").translate({10: " ", 13: " "}).encode("utf-8"),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Payload-Length: %d" % len(payload),
        *([b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"Content-Type: text/html",
        b"Content-Length: %d" % len(body),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the archive; raw content where too few to train."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:SAMPLE_PART] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, sample)) // 8)), sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def write_archive(records: list[bytes]) -> bytes:
    import zstandard

    raw = build_dictionary(records)
    # One frame each, with its content size, under the shared dictionary.
    z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    return struct.pack("<II", MAGIC, len(raw)) + raw + b"".join(map(z.compress, records))


def read_archive(data: bytes):
    """(headers, body) of each record of an archive, in time linear in its size."""
    import zstandard

    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        d, parts = z.decompressobj(), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + FEED_BYTES]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        plain = b"".join(parts)
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b": "), b"") for line in head.split(b"\r\n")[1:])
        yield fields, rest[: int(fields[b"Content-Length"])]


def store(uri: str, data: bytes) -> None:
    """Write a file by its URI, on whatever store the shared folder lives."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(data)


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in folder; returns (path, records) of those that count.

    A null id or url is written as an empty one, null html as an empty payload; rows that repeat are
    records of their own; other columns are ignored; an empty table gives no archive.
    """
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "sha": F.sha1("payload")})
    # Only repeated payloads need a partner; their number and first page are counted before the
    # join, and the copies of one payload are spread over SALT tasks.
    first = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("sha", "first_id", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("part"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    linked = rows.join(first, ["sha", "part"], "left").select("page_id", "url", "payload", F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.col("first_id")).alias("refers_to"))

    def run(batches):
        held, size = [], 0

        def flush():
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            store(path, write_archive(held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for b in batches:
            for k in range(b.num_rows):
                i, u, p, r = (c[k].as_py() for c in b.columns)
                held.append(record(i, u, p, r, sha1_base32(p)))
                size += len(p)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return linked.mapInArrow(tidied(run), "path string, records long")


def read_warcs(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the
    archives named in column path; a response's digest and length are taken from its body.

    An empty archive has no rows, one named twice is read twice; an archive that is cut off, or whose
    records do not match their digests, raises.
    """

    def page(urn: bytes) -> int | None:
        return int(urn[10:-1]) if len(urn) > 11 else None

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out = []
                for h, body in read_archive(data):
                    response = h[b"WARC-Type"] == b"response"
                    digest = sha1_base32(body) if response else h[b"WARC-Payload-Digest"][5:].decode()
                    if response and h[b"WARC-Payload-Digest"][5:].decode() != digest:
                        raise ValueError(f"a record of {uri} does not match its digest")
                    out.append((page(h[b"WARC-Record-ID"]), len(body) if response else int(h[b"WARC-Payload-Length"]), digest, h[b"WARC-Type"].decode(), None if response else page(h[b"WARC-Refers-To"])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path").mapInArrow(tidied(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def spread(listed: DataFrame) -> DataFrame:
    """The list of archives dealt to so many tasks that none reads more than a few."""
    n = listed.count()
    return listed.repartition(max(1, min(n, max(2 * listed.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ARCHIVES)))))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write every page to archives, then read them back.

    The archives stay where a folder is named; without one they lie in the shared folder and are
    deleted once they have been read.  Null html is an empty payload.  Of equal payloads the row with
    the smallest id is the response and the others revisit it; rows that repeat that id and payload
    are responses too, as nothing tells them apart, and null ids come last (a group of null ids only
    is all responses).  Other columns are ignored; an empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    with scratch_scope(spark) as scope:
        own = folder or new_path(spark, "warc")
        listed, _ = materialize(write_warcs(pages, own, id_col, url_col, html_col, min_revisit_bytes), "warc-list")
        out = finished(read_warcs(spread(listed)), "warc-records", scope)
        if folder is None:
            remove(spark, own)
    return out
