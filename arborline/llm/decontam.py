"""Benchmark decontamination by the q-gram lemma.

An alignment of an m-character item with at most e edits keeps at least m - q + 1 - q e of its
q-grams, all on diagonals that differ by at most e.  Matching q-grams are therefore counted in
bands of 2 (e + 1) diagonals that overlap by half, so that every such alignment lies whole in some
band; bands that reach the bound are verified by an alignment within the band's diagonals.  Texts
are compared lower-cased with white space runs as one blank.  Items too short for a q-gram are looked
for as whole words, without edits.

The benchmark is read in blocks of bounded size (BLOCK_CHARS); one block's index is shipped to a scan
of the documents, and a larger benchmark takes a scan for each block, one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tidied

#: Edits allowed for each character of an item, and the q-gram's length.
EDIT_RATE, Q = 0.08, 8
#: Characters of a benchmark block, and of the texts that are indexed together.
BLOCK_CHARS, GROUP_CHARS = 4 << 20, 1 << 20
#: Positions whose matches are expanded at a time.
EXPAND = 1 << 18
BITS = 22
#: Stands for a null item id while items are searched.
NO_ID = -(1 << 63)
_B = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every window of Q = 8 codes, by doubling."""
    h = c.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        m = np.uint64(pow(int(_B), step, 1 << 64))
        h = h[:-step] * m + h[step:]
    return h ^ (h >> np.uint64(31))


def budget(m: int) -> int:
    """Edits allowed to an item of m characters; the lemma needs one q-gram that they must leave."""
    return max(0, min(int(m * EDIT_RATE), (m - Q) // Q))


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, width: int, start: int, stop: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the item with a part of text[start:stop], on `width`
    diagonals (place in the text less place in the item) from `low` on; None beyond `most` edits.

    Row i of the table holds one cell for each diagonal, so the cost is the item's length times
    the band's width.
    """
    far = most + 1
    at = np.arange(width)
    # The characters that the cells of all rows look at; those outside start:stop match nothing.
    reach = np.full(len(item) + width, np.uint32(0xFFFFFFFF), dtype=np.uint32)
    a, b = max(start, low, 0), min(stop, low + len(reach))
    if a >= b:
        return None
    reach[a - low : b - low] = text[a:b]
    place = low + at  # text before the cell's place is behind it
    row = np.where((place >= start) & (place <= stop), 0, far)
    new = np.empty_like(row)
    for i, c in enumerate(item):
        np.add(row, reach[i : i + width] != c, out=new)  # both go on: the same diagonal
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])  # the item alone goes on: from the diagonal above
        place += 1
        new[(place < start) | (place > stop)] = far
        # The text alone goes on: from the diagonals below, one edit for each.
        np.minimum.accumulate(new - at, out=row)
        row += at
        row[(place < start) | (place > stop)] = far
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(place[end])) if row[end] <= most else None


class Index:
    """The q-grams of a block of benchmark items with their places."""

    def __init__(self, items: list[tuple[int, str]]):
        named = [(i, n) for i, t in items if (n := normal(t))]
        kept = [(i, n) for i, n in named if len(n) >= Q]
        self.short: dict[str, list[int]] = {}
        for i, n in named:
            if len(n) < Q:
                self.short.setdefault(n, []).append(i)
        self.short_words = sorted({n.count(" ") + 1 for n in self.short})
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        self.texts = [n for _, n in kept]
        self.codes = [codes(n) for n in self.texts]
        self.size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([budget(m) for m in self.size], dtype=np.int64)
        self.need = self.size - Q + 1 - Q * self.edits
        hashes = [gram_hashes(c) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.maybe = np.zeros(1 << BITS, dtype=bool)
        self.maybe[self.grams >> np.uint64(64 - BITS)] = True

    def bands(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs whose shared q-grams reach the item's bound."""
        h = gram_hashes(text)
        spot = np.flatnonzero(self.maybe[h >> np.uint64(64 - BITS)])
        at = np.searchsorted(self.grams, h[spot])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == h[spot]
        spot, at = spot[real], at[real]
        many = self.first[at + 1] - self.first[at]
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        lo = 0
        total = np.cumsum(many)
        while lo < len(spot):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPAND)))
            n = many[lo:hi]
            post = np.repeat(self.first[at[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.owner[post]
            diagonal = np.repeat(spot[lo:hi], n) - self.place[post] + self.size[item]
            band = diagonal // (self.edits[item] + 1)
            key, c = np.unique(np.concatenate([(item << 40) | band, (item << 40) | np.maximum(band - 1, 0)]), return_counts=True)
            found.append(key)
            counts.append(c)
            lo = hi
        if not found:
            return []
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        c = np.bincount(back, weights=np.concatenate(counts))
        enough = c >= self.need[key >> 40]
        return [(int(k >> 40), int(k & ((1 << 40) - 1))) for k in key[enough]]

    def short_matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Items shorter than a q-gram that are words of the text: their first places."""
        out = {}
        words = text.split(" ")
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        for k in self.short_words:
            for j in range(len(words) - k + 1):
                n = words[j] if k == 1 else " ".join(words[j : j + k]) if starts[j + k] - starts[j] <= Q else ""
                for i in self.short.get(n, ()) if n else ():
                    out.setdefault((i, n), (i, 0, starts[j], starts[j] + len(n)))
        return list(out.values())

    def align(self, item: int, band: int, text: np.ndarray, start: int, stop: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best alignment of an item on a band's diagonals."""
        e, c = int(self.edits[item]), self.codes[item]
        m, width = len(c), 2 * (e + 1)
        low = band * (e + 1) - m  # the band's first diagonal
        a, b = max(start, low), min(stop, low + width + m)
        if b - a < m - e:
            return None
        whole, part = text[a:b].tobytes(), c.tobytes()
        exact = whole.find(part)
        while exact > 0 and exact % 4:  # not at a character
            exact = whole.find(part, exact + 1)
        if exact >= 0:
            return 0, a + exact // 4, a + exact // 4 + m
        if not e or not (near := banded_alignment(c, text, low, width, start, stop, e)):
            return None
        # Backwards from that end: a place at x is at near - x of the turned text, diagonals are turned too.
        edits, end = near
        turned = text[max(start, low) : end][::-1]
        back = banded_alignment(c[::-1], turned, end - m - (low + width - 1), width, 0, len(turned), edits)
        return edits, end - back[1], end

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item id, edits, start, end) of the best match of each item in each text; places are
        those of the normalised text."""
        out: list[list] = [[] for _ in texts]
        group, held, held_chars = [], [], 0

        def search() -> None:
            starts = np.cumsum([0, *(len(c) + 1 for c in held)])
            gap = np.zeros(1, dtype=np.uint32)
            joined = np.concatenate([x for c in held for x in (c, gap)])
            if len(joined) < Q:
                return
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for item, band in self.bands(joined):
                e, m = int(self.edits[item]), int(self.size[item])
                low = band * (e + 1) - m
                first, last = max(0, low), min(len(joined), low + 2 * (e + 1) + m)
                for d in range(max(0, int(np.searchsorted(starts, first, "right")) - 1), min(len(held), int(np.searchsorted(starts, last, "left")))):
                    if best.get((d, item), (1,))[0] and (hit := self.align(item, band, joined, int(starts[d]), int(starts[d + 1]) - 1)):
                        best[d, item] = min(best.get((d, item), hit), hit)
            for (d, item), (edits, s, t) in sorted(best.items()):
                out[group[d]].append((int(self.ids[item]), edits, s - int(starts[d]), t - int(starts[d])))

        for i, t in enumerate(texts):
            n = normal(t)
            if self.short and n:
                out[i] += self.short_matches(n)
            if len(n) < Q or not len(self.ids):
                continue
            group.append(i)
            held.append(codes(n))
            held_chars += len(n)
            if held_chars >= GROUP_CHARS:
                search()
                group.clear()
                held.clear()
                held_chars = 0
        if held:
            search()
        return out


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items as lists of (id, text) of at most BLOCK_CHARS characters (one item at least)."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col).cast("string")).distinct().toLocalIterator(prefetchPartitions=False)
    block, size = [], 0
    for i, t in rows:
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end): each benchmark item found in each document, once.

    Items shorter than Q characters after normalisation are found as whole words; null and blank
    ones are never found.  Null and empty texts hold nothing; items of a null id are found with a
    null item_id; repeated rows repeat their findings, repeated benchmark rows do not; other columns
    are ignored; empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, edits int, start long, end long"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, shipped = docs.sparkSession.createDataFrame([], schema), None
    for block in benchmark_blocks(benchmark, item_col, item_text_col):
        if shipped is not None:  # one index at a time
            out, _ = materialize(out, "leaks")
            shipped.unpersist()
        shipped = index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches, index=index):
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(i, *hit) for i, hits in zip(ids, index.value.matches(b.column(1).to_pylist()), strict=True) for hit in hits]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

        out = out.union(src.mapInArrow(tidied(run), schema).withColumn("item_id", F.when(F.col("item_id") != NO_ID, F.col("item_id"))))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    Null and empty texts stay, as they hold nothing; rows that repeat stay or go together; ids play no
    part.  An empty benchmark keeps all, an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)
    out, shipped = docs.withColumn(text_col, F.col(text_col).cast("string")), None
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for block in benchmark_blocks(benchmark, item_col, item_text_col):
        if shipped is not None:
            out, _ = materialize(out, "without-leaks")
            shipped.unpersist()
        shipped = index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches, index=index):
            for b in batches:
                clean = [not hits for hits in index.value.matches(b.column(at).to_pylist())]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(tidied(run), schema)
    return out
