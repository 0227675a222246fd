"""Byte-pair encoding of words with an end sign, by a merge table that is read from a file."""

from __future__ import annotations

import gzip
import heapq
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The end sign of a word, the pattern that splits text, and the printable bytes of such vocabularies.
END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Words whose ids a table keeps, and tables that a worker keeps.
KNOWN_WORDS, KNOWN_TABLES = 1 << 16, 2


def byte_signs() -> list[str]:
    """The sign of each byte: itself where it is printable, else the next free sign above."""
    hidden = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
    return [hidden.get(b, chr(b)) for b in range(256)]


def read_merges(uri: str) -> list[tuple[str, str]]:
    """The pairs of a merge file, plain or gzip: a pair in each line, in their order; a first line that begins
    with # and empty lines are left out."""
    from ..sources.files import opened

    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        data = f.read()
    lines = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8").split("\n")
    pairs = [tuple(line.split()) for line in lines[1 if lines[0].startswith("#") else 0 :] if line.strip()]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"{uri} holds a line that is no pair")
    return pairs


class WordBpe:
    """Ids by place: bytes (printable ones first), bytes that end a word, merges in their order, special tokens."""

    def __init__(self, merges: Iterable[tuple[str, str]], special: Iterable[str] = ("<start>", "<end>")):
        self.sign, self.special = byte_signs(), tuple(special)
        pairs = list(merges)
        alone = [self.sign[b] for b in [*PRINTABLE, *sorted(set(range(256)) - set(PRINTABLE))]]
        self.tokens = alone + [s + END for s in alone] + ["".join(p) for p in pairs] + list(self.special)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.pattern = regex.compile("|".join([*map(regex.escape, self.special), SPLIT]), regex.IGNORECASE)
        self.word_ids = lru_cache(maxsize=KNOWN_WORDS)(self._word_ids)

    def pieces(self, word: str) -> list[str]:
        """A word's pieces: a chain of them, and a heap of the neighbours that a merge names.  All places of the
        earliest merge are joined, from the left, before the pairs that this makes are looked at."""
        text = [self.sign[b] for b in word.encode()]
        text[-1] += END
        after, before = [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def look(left: int) -> None:
            if left >= 0 and after[left] >= 0:
                pair = (text[left], text[after[left]])
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair], left, *pair))

        for i in range(len(text) - 1):
            look(i)
        while heap:
            now, made = heap[0][0], []
            while heap and heap[0][0] == now:
                _, left, a, b = heapq.heappop(heap)
                right = after[left]
                if text[left] != a or right < 0 or text[right] != b:
                    continue  # one of the two has been joined since
                text[left], text[right] = a + b, ""
                after[left] = after[right]
                if after[right] >= 0:
                    before[after[right]] = left
                made.append(left)
            for left in made:
                if text[left]:
                    look(before[left])
                    look(left)
        return [t for t in text if t]

    def _word_ids(self, word: str) -> tuple[int, ...]:
        lower = word.lower()
        if lower in self.special or word in self.special:
            return (self.ids[word if word in self.special else lower],)
        return tuple(self.ids[p] for p in self.pieces(word))

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in self.word_ids(m.group())]

    def decode(self, ids: Iterable[int]) -> str:
        """The text, a blank after each word; bytes that are no text are replaced."""
        byte = {s: bytes([b]) for b, s in enumerate(self.sign)}

        def one(token: str) -> bytes:
            if token in self.special:
                return token.encode()
            bare = token.removesuffix(END)
            return b"".join(byte[s] for s in bare) + b" " * (bare != token)

        return b"".join(one(self.tokens[i]) for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=KNOWN_TABLES)
def table_of(uri: str, special: tuple[str, ...]) -> WordBpe:
    return WordBpe(read_merges(uri), special)


def encoder(uri: str, special: tuple[str, ...] = ("<start>", "<end>")):
    """A column function: the ids of a text by the merge file, which each worker reads once.  The different words
    of a batch are encoded once each."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(s: pd.Series) -> pd.Series:
        bpe = table_of(uri, special)
        split = [None if t is None else bpe.pattern.findall(t) for t in s]
        ids = {w: bpe.word_ids(w) for w in {w for words in split if words for w in words}}
        return pd.Series([None if words is None else [i for w in words for i in ids[w]] for words in split], dtype=object)

    return encode


def decoder(uri: str, special: tuple[str, ...] = ("<start>", "<end>")):
    """A column function: the text of ids."""

    @pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        bpe = table_of(uri, special)
        return pd.Series([None if ids is None else bpe.decode(ids) for ids in s], dtype=object)

    return decode
