"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes disguises: case, marks, compatibility forms, letters of other scripts that look Latin,
digits and signs that stand for letters; i, l, 1, | and ! become one letter.  Entries of the lexicon are
beginnings of words or whole words, phrases may be exceptions: what stands inside one is no hit.

Weights are log odds learned from labelled rows.  What is counted is not documents but different pairs of
a word and the word before it, in toxic and in clean texts: a passage that is copied a thousand times
counts once, an insult in many sentences many times.  A weight is the lower end of its confidence
interval.  Phrases around an entry that clean texts have are learned as exceptions.  The score is a
logistic function of a text's strongest entry, its different entries and its hits over the root of its
length, fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_scope, tidied

#: Lower-case letters of other scripts, digits and signs by the Latin letter that they resemble.
LOOKALIKES = {
    "a": "αа4", "b": "βв8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һ", "i": "іιıl1ӏ", "j": "јϳ", "k": "кκ", "m": "м", "n": "ηп",
    "o": "оοσ0", "p": "рρ", "q": "ԛ", "s": "ѕ5", "t": "тτ7", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
SIGNS = {"a": "@", "s": "$", "i": "!|"}
_FOLDED = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
_SIGNS = {c: latin for latin, others in SIGNS.items() for c in others}
#: @ and $ may begin a word, ! and | stand inside one.
_SIGN = re.compile(r"[@$](?=\w)|(?<=\w)[!|](?=\w)")
_MARKS, _OTHER = re.compile("[̀-ͯ]+"), re.compile(r"[\W_]+")

#: Labelled rows of each class that the lexicon is learned from, taken by a hash of their ids.
LABELLED_TOXIC, LABELLED_CLEAN = 4000, 8000
#: Most candidates that come to the driver, letters of a beginning, least different pairs of an entry,
#: its least weight, standard errors of the interval, and clean texts that make a phrase an exception.
MOST_TERMS, SHORTEST, LONGEST, LEAST_PAIRS, LEAST_WEIGHT, ERRORS, LEAST_CLEAN = 20_000, 4, 12, 5, 0.7, 2.0, 5
FEATURES = 3
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 100_000
#: The logistic constant where no text is known to be toxic.
NOTHING_KNOWN = -7.0


def fold(text: str | None) -> str:
    """The words of a text, folded, with one space around each."""
    t = unicodedata.normalize("NFKD", (text or "").lower())
    if not t.isascii():
        t = _MARKS.sub("", t)
    t = _SIGN.sub(lambda m: _SIGNS[m[0]], t).translate(_FOLDED)
    return f" {_OTHER.sub(' ', t).strip()} "


class Lexicon:
    """Entries with weights, and exceptions, as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        import ahocorasick

        self.weights, self.automaton = weights, ahocorasick.Automaton()
        both = {w: (len(w), i, weights[w]) for i, w in enumerate(sorted(weights))} | {p: (len(p), -1, 0.0) for p in exceptions if p.strip()}
        for pattern, value in both.items():
            self.automaton.add_word(pattern, value)
        if both:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(entry, weight) of the hits that no exception covers."""
        found = [(end, *value) for end, value in self.automaton.iter(folded)] if len(self.automaton) else []
        spared = [(end - n + 1, end) for end, n, i, _ in found if i < 0]
        return [(i, w) for end, n, i, w in found if i >= 0 and not any(a <= end - n + 1 and end <= b for a, b in spared)]

    def features(self, text: str | None) -> tuple[float, ...]:
        folded = fold(text)
        hits = self.hits(folded)
        words = max(folded.count(" ") - 1, 1)
        return max((w for _, w in hits), default=0.0), sum(dict(hits).values()), sum(w for _, w in hits) / math.sqrt(words)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (constant first) by Newton's steps, drawn towards zero but for the constant."""
    if not y.any():
        return np.array([NOTHING_KNOWN, *[0.0] * x.shape[1]])
    a = np.hstack([np.ones((len(x), 1)), x])
    pull = np.diag([1e-6, *[ridge] * x.shape[1]])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + pull, a.T @ (y - p) - pull @ b)
        b = b + step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return b


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text divides by 5; a null id is none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", toxic: int = LABELLED_TOXIC, clean: int = LABELLED_CLEAN) -> DataFrame:
    """(id, toxic) of the rows to learn from: so many of each class, by a hash of the id.  An id that is
    labelled more than once is toxic if any label says so."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    take = lambda is_toxic, n: known.where(F.col("toxic") == is_toxic).orderBy(F.xxhash64("id"), "id").limit(n)
    return take(1, toxic).unionByName(take(0, clean))


def word_pairs(texts: DataFrame) -> DataFrame:
    """(toxic, before, word, texts): the different pairs of neighbouring words of texts (toxic, text), and how many
    texts have each."""

    def table(seen: Counter) -> pa.RecordBatch:
        columns = [*zip(*seen, strict=True), seen.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["toxic", "before", "word", "texts"])

    def run(batches):
        seen: Counter[tuple[int, str, str]] = Counter()
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                seen.update({(toxic, u, w) for u, w in zip(["", *words], words, strict=False)})
                if len(seen) >= HELD_PAIRS:
                    yield table(seen)
                    seen.clear()
        if seen:
            yield table(seen)

    return texts.select("toxic", "text").mapInArrow(tidied(run), "toxic int, before string, word string, texts long").groupBy("toxic", "before", "word").agg(F.sum("texts").alias("texts"))


def weight(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """The lower end of the confidence interval of the log odds."""
    odds = F.log((toxic + 0.5) / F.lit(all_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(all_clean + 1.0))
    return odds - F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) * ERRORS


def pruned(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """The entries worth keeping of candidates (toxic pairs, weight): no beginning whose pairs nearly all
    belong to a longer one, no longer one that a kept beginning outweighs."""
    longer = defaultdict(list)
    for term in found:
        for n in range(1 + SHORTEST, len(term)):
            longer[term[:n]].append(term)
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        pairs, w = found[term]
        if any(found[x][0] >= 0.9 * pairs and found[x][1] >= w - 0.2 for x in longer.get(term, ())):
            continue
        if not any(kept.get(term[:n], -math.inf) >= w - 0.2 for n in range(1 + SHORTEST, len(term))):
            kept[term] = w
    return kept


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: Iterable[str] = ()) -> tuple[dict[str, float], list[str], np.ndarray]:
    """(weights, exceptions, logistic weights).  The labelled rows are bounded, as is what they leave."""
    ids, _ = materialize(labelled(labels, id_col, label_col), "toxic-ids")
    # At most LABELLED_TOXIC + LABELLED_CLEAN ids.
    texts, _ = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("toxic", "text"), "toxic-texts")
    pairs, _ = materialize(word_pairs(texts), "toxic-pairs")
    is_toxic, is_clean = F.col("toxic") == 1, F.col("toxic") == 0
    total = pairs.agg(F.count_if(is_toxic).alias("t"), F.count_if(is_clean).alias("c")).first()
    all_toxic, all_clean = int(total["t"]), int(total["c"])
    words = pairs.groupBy("word").agg(F.count_if(is_toxic).alias("t"), F.count_if(is_clean).alias("c"))
    beginnings = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), n)))
    whole = F.array(F.concat(F.lit(" "), "word", F.lit(" ")))
    each = words.select(F.explode(F.when(F.length("word") >= SHORTEST, F.concat(whole, beginnings)).otherwise(whole)).alias("term"), "t", "c")
    terms = each.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= LEAST_PAIRS).withColumn("w", weight(F.col("t"), F.col("c"), all_toxic, all_clean))
    top = terms.where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc("w"), "term").limit(MOST_TERMS).collect()
    weights = pruned({r["term"]: (r["t"], r["w"]) for r in top})
    # Phrases of an entry and the word before it that several clean texts have and no toxic one.
    spared = [f"{fold(p)}" for p in exceptions]
    if weights:
        entry = reduce(lambda a, b: a | b, (F.concat(F.lit(" "), F.substring("word", 1, n)).isin([w for w in weights if len(w) == n + 1 and not w.endswith(" ")]) for n in range(SHORTEST, LONGEST + 1)))
        entry = entry | F.concat(F.lit(" "), "word", F.lit(" ")).isin([w for w in weights if w.endswith(" ")])
        phrases = pairs.where(entry).groupBy("before", "word").agg(F.count_if(is_toxic).alias("t"), F.sum(F.when(is_clean, F.col("texts")).otherwise(0)).alias("c"))
        spared += [f" {r['before']} {r['word']} " for r in phrases.where((F.col("c") >= LEAST_CLEAN) & (F.col("t") == 0) & (F.col("before") != "")).limit(MOST_TERMS).collect()]
    scored = features(texts, "text", weights, spared, "toxic").toArrow()  # the labelled rows' few numbers
    x, y = np.array(scored["features"].to_pylist(), float).reshape(-1, FEATURES), np.array(scored["toxic"].to_pylist(), float)
    return weights, spared, fitted(x, y)


def features(rows: DataFrame, text_col: str, weights: dict[str, float], exceptions: Iterable[str], *keep: str) -> DataFrame:
    """Columns to keep, and the features of each text."""
    entries, spared = dict(weights), list(exceptions)

    def run(batches):
        lexicon = Lexicon(entries, spared)
        for b in batches:
            x = pa.array([lexicon.features(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], names=[*keep, "features"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, F.col(text_col).alias("_folded_text")).mapInArrow(tidied(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "features array<double>"]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: Iterable[str] = ()) -> DataFrame:
    """(id, held_out, score, predicted, features) of every document.

    Nothing but the text enters a score.  Labels are learned from rows that are not held out, at most
    LABELLED_TOXIC and LABELLED_CLEAN of them, over their whole texts.  Null texts count as empty and
    score by the constant alone; a null id is scored, is not held out and teaches nothing; ids without a
    label, labels other than 0 and 1, and labels without a document teach nothing.  Without toxic labels
    every score is near 0.  Repeated rows each get theirs.  Other columns are ignored; an empty table
    gives an empty result.
    """
    with scratch_scope(docs.sparkSession):
        weights, spared, b = learned(docs, labels, id_col, text_col, label_col, exceptions)
        rows = features(docs.select(F.col(id_col), F.col(text_col)), text_col, weights, spared, id_col)
        z = reduce(lambda s, i: s + F.get("features", F.lit(i)) * float(b[1 + i]), range(FEATURES), F.lit(float(b[0])))
        score = 1 / (1 + F.exp(-z))
        return rows.select(id_col, held_out(id_col).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "features")
