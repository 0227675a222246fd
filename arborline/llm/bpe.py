"""Byte-pair encoding by prefix-sharing trie traversal.

The distinct words of a batch, sorted, are a trie laid out in preorder: the common prefix of two
neighbours is the branching node.  The traversal keeps for every prefix length the last token of
that prefix's encoding.  The encoding of a prefix is the encoding of a shorter prefix plus one
token that the merge rules would leave apart from the token before it; exactly one suffix token
is such, so a node's state follows from the states above it, and what words share is computed
once.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: The byte-level pre-tokenizer's published split pattern (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's word cache (of each of two generations) and of its pair cache.
MAX_WORDS, MAX_PAIRS = 200_000, 400_000
#: Words of a text handled at a time, so that a text of any length needs bounded memory.
BLOCK_WORDS = 100_000
#: Characters of short texts whose words are learned together.
GROUP_CHARS = 1_500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by their published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Two generations of entries: what the older one is asked for moves to the younger."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, word):
        self[word] = found = self.older[word]
        return found

    def age(self):
        self.older = dict(self)
        self.clear()


class TrieBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sym = byte_symbols()
        raw = lambda s: bytes(sym[c] for c in s)
        vocab = spec["model"]["vocab"]
        ids = {raw(s): i for s, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Inner numbers: bytes first, then merges in order of rank.
        self.rank = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.rank[raw(left)], self.rank[raw(right)]
            self.joined[a, b] = self.rank[raw(left) + raw(right)] = len(self.halves)
            self.halves.append((a, b))
        self.size = [0] * len(self.halves)
        self.ids = [0] * len(self.halves)
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ids.items()}
        for t, k in self.rank.items():
            self.size[k], self.ids[k] = len(t), ids.get(t, -1)
        # The length of the longest token by its last three bytes (all of a shorter one's).
        self.longest: dict[bytes, int] = {}
        for t in self.rank:
            self.longest[t[-3:]] = max(len(t), self.longest.get(t[-3:], 0))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(SPLIT)
        self.apart: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], tuple[tuple[int, int], ...]] = {}
        self.seqs = Cache()
        self.decimal = {i: str(i) for i in self.bytes_of}

    def edge(self, token: int, right: bool) -> tuple[tuple[int, int], ...]:
        """The pieces that stand at one end of a token while the rules build it up, from its byte to
        itself, each with the rank of the merge that ends it (for the token itself: none ever does)."""
        found, ended = [], len(self.halves)
        while True:
            found.append((token, ended))
            if token < 256:
                return tuple(reversed(found))
            ended, token = token, self.halves[token][1 if right else 0]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the rules, applied to the joined strings of tokens a and b, give back a, b.

        Merges go by rank, and the piece that a merge makes has the merge's rank.  So at any time one
        piece of a and one of b meet at the seam; they are merged if their own rank comes before the
        merges that end them, at equal ranks the one further left first."""
        key = a * len(self.halves) + b
        if (known := self.apart.get(key)) is not None:
            return known
        if len(self.edges) >= MAX_PAIRS:
            self.edges.clear()
        for k in ((a, True), (b, False)):
            if k not in self.edges:
                self.edges[k] = self.edge(*k)
        left, right = self.edges[a, True], self.edges[b, False]
        i = j = 0
        out = True
        while i < len(left) and j < len(right):
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.joined.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                out = False
                break
            i, j = i + (x_ends <= y_ends), j + (y_ends <= x_ends)
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        self.apart[key] = out
        return out

    def traverse(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, token ids) for distinct words, in trie preorder."""
        last, before = [0], b""
        rank, apart, base = self.rank.get, self.apart.get, len(self.halves)
        size, ids, longest = self.size, self.ids, self.longest.get
        for w in sorted(words):
            n, depth, top = len(w), 0, min(len(w), len(before))
            while depth < top and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :]
            for i in range(depth + 1, n + 1):
                far = longest(w[i - 3 : i], 2) if i > 3 else i
                for j in range(i - far if i > far else 0, i):
                    if (t := rank(w[j:i])) is not None and (j == 0 or (known if (known := apart(last[j] * base + t)) is not None else self._stay_apart(last[j], t))):
                        break
                last.append(t)
            seq, i = [], n
            while i:
                t = last[i]
                seq.append(ids[t])
                i -= size[t]
            seq.reverse()
            before = w
            yield w, seq

    def learn(self, words: Iterable[str]) -> None:
        """Have the encodings of words at hand until the next call."""
        if len(self.seqs) >= MAX_WORDS:
            self.seqs.age()
        seqs, older = self.seqs, self.seqs.older
        new = {w.encode("utf-8"): w for w in set(words) if w not in seqs and w not in older}
        decimal, bytes_of = self.decimal.__getitem__, self.bytes_of.__getitem__
        for raw, seq in self.traverse(new):
            seqs[new[raw]] = (",".join(map(decimal, seq)), len(seq), b"".join(map(bytes_of, seq)))

    def blocks(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special tokens between them."""
        parts, at = [], 0
        for m in self.special_split.finditer(text) if self.special_split else ():
            parts += [(at, m.start(), self.special[m.group()])]
            at = m.end()
        for lo, hi, special in [*parts, (at, len(text), None)]:
            if hi - lo <= GROUP_CHARS:
                if hi > lo:
                    yield self.words.findall(text[lo:hi] if parts else text)
            else:
                found = (m.group() for m in self.words.finditer(text[lo:hi]))
                while block := list(islice(found, BLOCK_WORDS)):
                    yield block
            if special is not None:
                yield special

    def encode_block(self, block: list[str] | int) -> tuple[str, int, bytes]:
        """The decimal ids of words that were learned last, their number, and the bytes they decode to."""
        if isinstance(block, int):
            return str(block), 1, self.bytes_of[block]
        ids, n, raw = zip(*map(self.seqs.__getitem__, block), strict=True)
        return ",".join(ids), sum(n), b"".join(raw)

    def encode(self, texts: Iterable[str | None]) -> Iterator[Iterator[tuple[str, int, bytes]]]:
        """For each text its decimal token ids, their number and their bytes, block by block; each text is
        to be read to its end before the next.  Short texts are learned together."""

        def long(text):
            for block in self.blocks(text):
                if not isinstance(block, int):
                    self.learn(block)
                yield self.encode_block(block)

        def short(group):
            split = [list(self.blocks(t)) for t in group]
            self.learn(chain.from_iterable(b for bs in split for b in bs if not isinstance(b, int)))
            for bs in split:
                yield map(self.encode_block, bs)

        group, held = [], 0
        for t in texts:
            t = t or ""
            if held + len(t) > GROUP_CHARS:
                yield from short(group)
                group, held = [], 0
            if len(t) > GROUP_CHARS:
                yield long(t)
            else:
                group.append(t)
                held += len(t)
        yield from short(group)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> TrieBpe:
    """One tokenizer for each worker and vocabulary file."""
    return TrieBpe(path)


def digests(bpe: TrieBpe, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
    """(number of tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text) of each."""
    for blocks in bpe.encode(texts):
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        for ids, k, raw in blocks:
            ids_hash.update((("," if n else "") + ids).encode())
            n += k
            text_hash.update(utf8.decode(raw).encode("utf-8"))
        text_hash.update(utf8.decode(b"", True).encode("utf-8"))
        yield n, ids_hash.hexdigest(), text_hash.hexdigest()


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each input row.

    Null texts count as empty: no tokens, the digests of nothing.  Ids pass through as they are,
    null or repeated; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        bpe = load(vocab_path)
        for b in batches:
            rows = list(digests(bpe, (t.as_py() for t in b.column(1))))
            n, a, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids themselves, one row for each input row.  Null and empty texts have
    no tokens; ids pass through, null or repeated; other columns are ignored; an empty table gives an
    empty result."""

    def run(batches):
        bpe = load(vocab_path)
        for b in batches:
            ids = [[int(i) for part, _, _ in blocks for i in part.split(",")] for blocks in bpe.encode(t.as_py() for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, ids array<int>")
