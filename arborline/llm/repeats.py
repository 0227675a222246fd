"""Removal of repeated passages by maximal repeats of sharded enhanced suffix arrays.

A string of MIN_BYTES bytes is dealt to a shard by the smallest hash of its 24-byte substrings, so
equal strings meet wherever they stand, and neighbouring strings with the same smallest hash
travel as one fragment.  Each shard sorts the suffixes of its fragments, scans the common-prefix
lengths with a stack into the intervals of the common-prefix tree, and keeps those intervals of
MIN_BYTES or more whose occurrences differ in the byte to their left (or stand at a fragment's
start): the maximal repeat groups, each with all its occurrences and its smallest document.

Texts are packed in chunks and kept in a table of the shared warehouse bucketed by chunk.  Chunks
first announce their distinct anchor hashes; only anchors of two or more documents come back, and
only their fragments travel.  Exact copies are found by their digests, and of a group only the
document of the smallest id takes part.  Anchors that very many documents hold are dealt string by string
instead, by the hash of the whole string, and equal strings of a chunk travel once, so that no
shard grows with the number of copies.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, materialize, new_path, remove, scratch_scope, tidied

MIN_BYTES, GRAM = 50, 24
#: Raw bytes of a chunk; anchors and text bytes that a shard is planned for.
CHUNK_BYTES, SHARD_ANCHORS, SHARD_BYTES = 2 << 20, 1 << 20, 3 << 19
#: Windows of a fragment (so that two strings hold all its bytes); documents from which an anchor's strings are dealt one by one.
MAX_WINDOWS, HOT_DOCS = 50, 2000
#: The document number of a null id: after all others.
LAST = np.iinfo(np.int64).max
#: Ways in which the exact copies of one text are spread, and files at most that each task of the
#: packing writes (a bucket may hold any number of chunks).
SALT, MOST_BUCKETS = 16, 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_anchors(data: np.ndarray) -> np.ndarray:
    """For each start of a MIN_BYTES window the smallest hash of its GRAM-byte substrings."""
    h = data.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8, GRAM - 16):
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
    h = mix(h)
    left = MIN_BYTES - GRAM + 1  # 35 substrings
    step = 1
    while 2 * step <= left:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (left - step)], h[left - step :])


class Chunk:
    """Documents laid end to end: ids, starts (one more than documents), bytes, and which of them
    copy a document of a smaller id."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, copies: bytes | None = None):
        import zstandard

        n = np.frombuffer(sizes, dtype=np.int64)
        self.none = n < 0  # of a null id: less than zero by its size and one
        n = np.where(self.none, -1 - n, n)
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(n.sum())) if n.sum() else b""
        self.ids, self.starts, self.data = np.frombuffer(ids, dtype=np.int64), np.concatenate([[0], np.cumsum(n)]), np.frombuffer(raw, dtype=np.uint8)
        self.copy = np.zeros(len(n), dtype=bool)
        self.copy[np.frombuffer(copies or b"", dtype=np.int32)] = True

    @staticmethod
    def of(table, k: int = 0) -> Chunk:
        """The chunk in row k of a table or batch."""
        return Chunk(*(table.column(table.schema.get_field_index(c))[k].as_py() for c in ("ids", "sizes", "data", "copies")))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, anchor) of every run of windows with one anchor in a document."""
        none = np.zeros(0, np.int64)
        if len(self.data) < MIN_BYTES:
            return none, none, none.astype(np.uint64)
        anchor = window_anchors(self.data)
        inside = np.zeros(len(self.data) + 1, dtype=np.int32)
        size = np.diff(self.starts)
        long = (size >= MIN_BYTES) & ~self.copy
        np.add.at(inside, self.starts[:-1][long], 1)
        np.add.at(inside, self.starts[1:][long] - MIN_BYTES + 1, -1)
        valid = np.cumsum(inside)[: len(anchor)] > 0
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        new[np.minimum(self.starts[:-1], len(anchor) - 1)] = True
        edge = np.flatnonzero(new)
        n = np.diff(np.append(edge, len(anchor)))
        # A run ends where the windows of its document do.
        doc = np.searchsorted(self.starts, edge, "right") - 1
        n = np.minimum(n, self.starts[doc + 1] - MIN_BYTES + 1 - edge)
        ok = valid[edge] & (n > 0)
        return edge[ok], n[ok], anchor[edge[ok]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def maximal_repeats(suffix: np.ndarray, size: np.ndarray, left: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, groups): the suffix array, and for every maximal repeat of `least` bytes or more its
    length, its interval of the suffix array (from, to) and its smallest owner.

    suffix: fixed-width byte strings padded with zeros, size: their true lengths, left: the byte
    before each, -1 where there is none, which differs from all others.
    """
    order = np.argsort(suffix, kind="stable")
    width = suffix.dtype.itemsize
    lcp = np.empty(max(0, len(order) - 1), dtype=np.int64)
    for lo in range(0, len(lcp), 1 << 16):  # common prefixes of neighbours in the suffix array
        rows = suffix[order[lo : lo + (1 << 16) + 1]].view(np.uint8).reshape(-1, width)
        differ = rows[1:] != rows[:-1]
        lcp[lo : lo + (1 << 16)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    size, own, before = size[order], owner[order], left[order]
    lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
    lcp[lcp < least] = 0
    varied = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))]).tolist()
    stack: list[list[int]] = []  # open intervals: length, first suffix, smallest owner
    ids, pre, groups = own.tolist(), before.tolist(), []
    for i, n in enumerate([*lcp.tolist(), 0], 1):
        first, small = i - 1, ids[i - 1]
        while stack and stack[-1][0] > n:
            long, first, low = stack.pop()
            small = min(small, low)
            if varied[i - 1] > varied[first] or pre[first] < 0:
                groups.append((long, first, i, small))
            if stack and stack[-1][0] >= n:
                stack[-1][2] = min(stack[-1][2], small)
        if n:
            if not stack or stack[-1][0] < n:
                stack.append([n, first, small])
            else:
                stack[-1][2] = min(stack[-1][2], small)
    return order, np.array(groups, dtype=np.int64).reshape(-1, 4)


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which one each unit belongs to, and its number there."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - (np.cumsum(n) - n)[which]


def pack_chunks(docs: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """docs (id, text) as a table of chunks, bucketed by chunk, whose files stand in a shared folder."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        z, base, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, 0
        ids, parts, sizes, held = [], [], [], 0

        def row():
            data = z.compress(b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([held], pa.int64()), pa.array([np.int64(ids).tobytes()], pa.binary()), pa.array([np.int64(sizes).tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["chunk", "n_bytes", "ids", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(LAST if i.as_py() is None else i.as_py())
                parts.append((t.as_py() or "").encode("utf-8"))
                sizes.append(len(parts[-1]) if i.as_py() is not None else -1 - len(parts[-1]))
                held += len(parts[-1])
                if held >= CHUNK_BYTES:
                    yield row()
                    ids, parts, sizes, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield row()

    out = docs.mapInArrow(tidied(run), "chunk long, n_bytes long, ids binary, sizes binary, data binary")
    out.write.bucketBy(buckets, "chunk").option("compression", "uncompressed").option("path", path).saveAsTable(table)
    return docs.sparkSession.table(table)


def digests(batches):
    """From chunks: (chunk, doc, place, sha) of every document; doc is its number in the chunk."""
    for b in batches:
        for k in range(b.num_rows):
            c = Chunk(b.column(1)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].as_py())
            sha = [hashlib.sha256(c.data[a:e]).digest() for a, e in zip(c.starts[:-1], c.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(sha), pa.int64()), pa.array(range(len(sha)), pa.int32()), pa.array(c.ids), pa.array(sha, pa.binary())], names=["chunk", "doc", "place", "sha"])


def copy_lists(key, table):
    """The numbers of a chunk's copies as one value."""
    return _table([[key[0].as_py()], [np.int32(table["doc"].to_pylist()).tobytes()]], ["chunk", "copies"], (pa.int64(), pa.binary()))


def _keys(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, 40-bit key) of anchors; a chance collision only lets a few more fragments travel."""
    x = mix(anchor + np.uint64(0x632BE59BD9B4E019))
    return ((x & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64), x >> np.uint64(24)


def _table(cols, names, types):
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def announce(shards: int):
    """From chunks: for each shard the distinct anchors and in how many documents of the chunk
    (up to 255) they stand."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk.of(b, k)
                at, _, anchor = c.runs()
                if not len(at):
                    continue
                shard, key = _keys(anchor, shards)
                full = shard.astype(np.uint64) << np.uint64(40) | key
                order = np.lexsort((c.doc_of(at), full))
                f, d = full[order], c.doc_of(at)[order]
                fresh = np.ones(len(f), dtype=bool)
                fresh[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                u, n = np.unique(f[fresh], return_counts=True)
                cut = np.searchsorted(u, np.arange(shards + 1, dtype=np.uint64) << np.uint64(40))
                five = u.view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(s, five[a:e].tobytes(), np.minimum(n[a:e], 255).astype(np.uint8).tobytes()) for s, (a, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > a]
                yield from _table([[s for s, _, _ in rows], [b.column(0)[k].as_py()] * len(rows), [x for _, x, _ in rows], [x for _, _, x in rows]], ["shard", "chunk", "keys", "docs"], (pa.int32(), pa.int64(), pa.binary(), pa.binary())).to_batches()

    return run


def shared_anchors(hot_docs: int):
    return lambda key, table: _shared(key, table, hot_docs)


def _shared(key, table, hot_docs):
    """Of a shard's anchors those of two or more documents, back to each chunk; bit 63 marks those
    of very many."""
    keys, owner, docs = [], [], []
    for i in range(table.num_rows):
        five = np.frombuffer(table["keys"][i].as_py(), dtype=np.uint8).reshape(-1, 5)
        full = np.zeros((len(five), 8), dtype=np.uint8)
        full[:, :5] = five
        keys.append(full.view(np.uint64).ravel())
        owner.append(np.full(len(five), i, dtype=np.int32))
        docs.append(np.frombuffer(table["docs"][i].as_py(), dtype=np.uint8))
    keys, owner, docs = np.concatenate(keys), np.concatenate(owner), np.concatenate(docs).astype(np.int64)
    u, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=docs)[back]
    some = total >= 2
    marked = (keys | np.uint64(key[0].as_py()) << np.uint64(40) | (total >= hot_docs).astype(np.uint64) << np.uint64(63))[some]
    owner = owner[some]
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(table.num_rows + 1))
    out = [(table["chunk"][i].as_py(), marked[order[a:e]].tobytes()) for i, (a, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > a]
    return _table([[c for c, _ in out], [x for _, x in out]], ["chunk", "keys"], (pa.int64(), pa.binary()))


def fragments(shards: int, stores: int):
    """From a chunk and its shared anchors: the distinct fragments for each store of suffixes, with
    the smallest document of the chunk and all places in it."""

    def run(left, right):
        names, types = ["store", "chunk", "sizes", "ids", "counts", "places", "data"], (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        if not left.num_rows or not right.num_rows:
            return _table([[]] * 7, names, types)
        c = Chunk.of(left)
        want = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in right["keys"]])
        hot_bit = np.uint64(1) << np.uint64(63)
        hot = np.sort(want[want >= hot_bit] ^ hot_bit)
        want = np.sort(want & ~hot_bit)
        at, n, anchor = c.runs()
        shard, key = _keys(anchor, shards)
        full = shard.astype(np.uint64) << np.uint64(40) | key
        has = lambda s: len(s) and s[np.minimum(np.searchsorted(s, full), len(s) - 1)] == full
        take = np.flatnonzero(has(want))
        single = has(hot) if len(hot) else np.zeros(len(full), dtype=bool)
        store = (mix(anchor + np.uint64(1)) % np.uint64(stores)).astype(np.int64).tolist()
        raw, ids, docs = c.data.tobytes(), c.ids.tolist(), c.doc_of(at).tolist()
        at, n, single = at.tolist(), n.tolist(), single.tolist()
        found: dict[bytes, list] = {}
        for k in take.tolist():
            step = 1 if single[k] else MAX_WINDOWS
            for p in range(at[k], at[k] + n[k], step):
                text = raw[p : min(p + step, at[k] + n[k]) + MIN_BYTES - 1]
                if (f := found.get(text)) is None:
                    found[text] = [zlib.crc32(text) % stores if single[k] else store[k], ids[docs[k]], [p]]
                else:
                    f[1] = min(f[1], ids[docs[k]])
                    f[2].append(p)
        groups: dict[int, list] = {}
        for text, (s, i, places) in found.items():
            groups.setdefault(s, []).append((text, i, places))
        rows = []
        for s, fs in groups.items():
            rows.append((s, np.uint16([len(t) for t, _, _ in fs]).tobytes(), np.int64([i for _, i, _ in fs]).tobytes(), np.uint32([len(p) for _, _, p in fs]).tobytes(), np.uint32([x for _, _, p in fs for x in p]).tobytes(), b"".join(t for t, _, _ in fs)))
        chunk = left["chunk"][0].as_py()
        return _table([[r[0] for r in rows], [chunk] * len(rows), *([r[i] for r in rows] for i in range(1, 6))], names, types)

    return run


def repeats_of_store(table):
    """For each chunk's fragments the smallest document of each window that maximal repeat groups
    cover, with the fragment's places."""
    names, types = ["chunk", "places", "counts", "windows", "firsts"], (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    load = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in table[name]]
    sizes, ids, counts, places = load("sizes", np.uint16), load("ids", np.int64), load("counts", np.uint32), load("places", np.uint32)
    size = np.concatenate(sizes).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_py() for x in table["data"]) + bytes(MIN_BYTES + MAX_WINDOWS), dtype=np.uint8)
    start = np.cumsum(size) - size
    windows = size - MIN_BYTES + 1
    first = np.cumsum(windows) - windows  # a fragment's first window
    ids = np.concatenate(ids)
    h = data.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8, 16):
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
    h = mix(h[: len(h) - MIN_BYTES + 32] * _M1 + h[MIN_BYTES - 32 :])  # of each string of MIN_BYTES
    # Equal fragments, whose first and last strings hold all their bytes, become suffixes once.
    head, foot = h[start], h[start + windows - 1]
    by = np.lexsort((size, foot, head))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (head[by[1:]] != head[by[:-1]]) | (foot[by[1:]] != foot[by[:-1]]) | (size[by[1:]] != size[by[:-1]])
    kind = np.empty(len(by), dtype=np.int64)
    kind[by] = np.cumsum(new) - 1
    one = by[new]
    least = np.full(len(one), LAST, dtype=np.int64)
    np.minimum.at(least, kind, ids)
    frag, off = expand(windows[one])
    at = start[one][frag] + off
    owner = least[frag]
    base = np.cumsum(windows[one]) - windows[one]
    lowest = owner.copy()
    # Strings that stand once are in no repeat: only the others become suffixes.
    _, back, n = np.unique(h[at], return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[back] > 1)
    if len(some):
        reach = int(size.max())
        rest = size[one][frag[some]] - off[some]
        text = data[np.minimum(at[some][:, None] + np.arange(reach, dtype=np.int32), len(data) - 1)]
        text[np.arange(reach) >= rest[:, None]] = 0
        left = np.where(off[some] > 0, data[np.maximum(at[some] - 1, 0)].astype(np.int64), -1)
        order, groups = maximal_repeats(text.view(f"S{reach}").ravel(), rest, left, owner[some], MIN_BYTES)
        del text
        for lo in range(0, len(groups), 4096):
            g = groups[lo : lo + 4096]
            member, k = expand(g[:, 2] - g[:, 1])  # every occurrence of a group
            first_window = some[order[g[member, 1] + k]]
            j, step = expand(g[member, 0] - MIN_BYTES + 1)  # every window that it covers
            np.minimum.at(lowest, first_window[j] + step, g[member[j], 3])
    whole, j = expand(windows)
    lowest, owner = lowest[base[kind[whole]] + j], ids[whole]
    edge = np.cumsum([0, *(len(s) for s in sizes)])
    out = []
    for k in range(table.num_rows):
        a, b = int(edge[k]), int(edge[k + 1])
        lo, hi = int(first[a]), int(first[b - 1] + windows[b - 1])
        mine = lowest[lo:hi] < owner[lo:hi]
        # Nothing to say to a chunk whose fragments stand once and have no smaller document.
        speak = np.logical_or.reduceat(mine, first[a:b] - lo) | (counts[k] > 1)
        if speak.any():
            w = np.repeat(speak, windows[a:b])
            out.append((table["chunk"][k].as_py(), places[k][np.repeat(speak, counts[k])].tobytes(), counts[k][speak].tobytes(), windows[a:b][speak].astype(np.uint16).tobytes(), lowest[lo:hi][w].tobytes()))
    return _table([[r[i] for r in out] for i in range(5)], names, types)


def finish(with_text: bool):
    """What is left of each document of a chunk, from its windows' smallest documents."""
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if with_text:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names, types = [*names, "spans", "kept"], [*types, span, pa.binary()]

    def run(left, right):
        if not left.num_rows:
            return _table([[]] * len(names), names, types)
        c = Chunk.of(left)
        gone = np.zeros(len(c.data) + 1, dtype=np.int32)
        for k in range(right.num_rows):
            places, counts, windows, firsts = (np.frombuffer(right[n][k].as_py(), dtype=t) for n, t in (("places", np.uint32), ("counts", np.uint32), ("windows", np.uint16), ("firsts", np.int64)))
            base = np.cumsum(windows.astype(np.int64)) - windows
            frag = np.repeat(np.arange(len(counts)), counts)
            n = windows[frag].astype(np.int64)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = np.repeat(places.astype(np.int64), n) + j
            small = firsts[np.repeat(base[frag], n) + j]
            mine = c.ids[np.repeat(c.doc_of(places.astype(np.int64)), n)]
            hit = window[small < mine]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + MIN_BYTES, -1)
        removed = np.cumsum(gone)[:-1] > 0
        rows = []
        for i, none, a, b, copy in zip(c.ids.tolist(), c.none.tolist(), c.starts[:-1].tolist(), c.starts[1:].tolist(), c.copy.tolist(), strict=True):
            r = np.ones(b - a, dtype=bool) if copy and b - a >= MIN_BYTES else removed[a:b]
            edges = np.flatnonzero(np.diff(r, prepend=False, append=False)) if b > a else np.zeros(0, np.int64)
            kept = c.data[a:b][~r].tobytes() if len(edges) else c.data[a:b].tobytes()
            row = (None if none else i, b - a, int(r.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
            rows.append((*row, [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], kept) if with_text else row)
        return _table([[r[i] for r in rows] for i in range(len(names))], names, types)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = HOT_DOCS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row; with_text:
    also spans (start, end of each removed run of bytes) and kept (the remaining bytes).

    A byte goes if a string of MIN_BYTES bytes that covers it starts in a document of a smaller id
    too.  Null texts are empty; a null id comes after all others (and beside the id 2^63 - 1); rows
    of one id are one document's and do not remove from each other; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(slots, -(-total // (18 * SHARD_ANCHORS)))
    stores = max(2 * slots, -(-total // SHARD_BYTES))
    buckets = min(MOST_BUCKETS, max(slots, -(-total // (4 * CHUNK_BYTES))))
    table, path = f"chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    try:
        with scratch_scope(spark) as scope:
            chunks = pack_chunks(src, table, path, buckets)
            known, _ = materialize(chunks.select("chunk", "ids", "sizes", "data").mapInArrow(tidied(digests), "chunk long, doc int, place long, sha binary"), "digests")
            # Only digests that repeat meet their documents, and the copies of one text are spread.
            firsts = known.groupBy("sha").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
            firsts = firsts.select("sha", "first", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("part"))
            spread = known.withColumn("part", F.pmod(F.xxhash64("chunk", "doc"), F.lit(SALT)).cast("int"))
            copies = spread.join(firsts, ["sha", "part"]).where("place > first").select("chunk", "doc").groupBy("chunk").applyInArrow(tidied(copy_lists), "chunk long, copies binary")
            chunks = chunks.join(materialize(copies, "copies")[0], "chunk", "left")
            heard = chunks.select("chunk", "ids", "sizes", "data", "copies").mapInArrow(tidied(announce(shards)), "shard int, chunk long, keys binary, docs binary")
            shared = heard.groupBy("shard").applyInArrow(tidied(shared_anchors(hot_docs)), "chunk long, keys binary")
            sent = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(tidied(fragments(shards, stores)), "store int, chunk long, sizes binary, ids binary, counts binary, places binary, data binary")
            told = sent.groupBy("store").applyInArrow(tidied(repeats_of_store), "chunk long, places binary, counts binary, windows binary, firsts binary")
            schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,end:long>>, kept binary" if with_text else "")
            return finished(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(tidied(finish(with_text)), schema), "repeats", scope)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)
