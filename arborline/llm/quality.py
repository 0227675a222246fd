"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model runs over 4-grams of UTF-16 units, unfolded; one fits a long exactly, so no two share a
count, and the tables grow with the corpus.  Documents are dealt to blocks by id and travel
packed.  A block tells how often each of its 4-grams occurs in trusted documents (zero: only
scoring needs it).  The count tables stay sharded by n-gram: they are joined with their contexts'
totals, then level by level with the n-grams that scoring needs, and every block gets the
probabilities of its own 4-grams back.  No table is collected or broadcast by this module.

One in CALIBRATE trusted documents, chosen by the hash of its id, is kept out of the counts.  These
are to the model what any other good document is, so a quantile of their log-perplexities in each
language is that language's threshold, without any allowance: beyond it a document is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finished, materialize, remove, scratch_scope, tidied

#: Units of an n-gram, and the number of different units over which the lowest order is uniform.
ORDER, UNITS = 4, 1 << 16
#: Of so many trusted documents one calibrates; the quantile of these that is the threshold.
CALIBRATE, UPPER = 2, 0.999
#: Shorter texts tell too little: their score is drawn towards their language's median, in proportion
#: to their length; so are those of the documents that calibrate.
STEADY_CHARS = 1000
#: Parts in which the rows of one id are dealt.
SALT = 16
#: Characters of a block of documents on average, and characters made into n-grams at a time.
BLOCK_CHARS, STEP_CHARS = 16 << 20, 1 << 20
#: Bytes of rows packed together, and of all rows that a task holds unpacked.
PACK_BYTES, HELD_BYTES = 4 << 20, 24 << 20
SLOT_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str):
    """The 4-grams of a text as 64-bit numbers, line ends standing before its start, in steps."""
    tail = np.full(ORDER - 1, 10, dtype=np.uint16)
    for lo in range(0, len(text), STEP_CHARS):
        units = np.frombuffer(text[lo : lo + STEP_CHARS].encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        s = np.concatenate([tail, units])
        g = s[: len(units)].astype(np.uint64)
        for i in range(1, ORDER):
            g = (g << np.uint64(16)) | s[i : len(units) + i]
        tail = s[1 - ORDER :]
        yield g


def _slots(g: np.ndarray) -> np.ndarray:
    return ((g * _ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Tally:
    """How often each 4-gram occurs: most have a slot of their own, the others are sorted."""

    def __init__(self):
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.used = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, g: np.ndarray, weight: int) -> None:
        at = _slots(g)
        free = ~self.used[at]
        self.keys[at[free]] = g[free]
        self.used[at[free]] = True
        own = self.keys[at] == g
        if weight:
            self.counts += np.bincount(at[own], minlength=len(self.counts))
        if not own.all():
            u, n = np.unique(g[~own], return_counts=True)
            self.rest.append((u, n * weight))
            if len(self.rest) > 16:
                self.fold()

    def fold(self) -> None:
        u, back = np.unique(np.concatenate([u for u, _ in self.rest]), return_inverse=True)
        n = np.zeros(len(u), dtype=np.int64)
        np.add.at(n, back, np.concatenate([n for _, n in self.rest]))
        self.rest = [(u, n)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.rest:
            self.fold()
        g = np.concatenate([self.keys[self.used], *(u for u, _ in self.rest)])
        n = np.concatenate([self.counts[self.used], *(n for _, n in self.rest)])
        order = np.argsort(g)
        return g[order], n[order]


class Lookup:
    """The values of 4-grams, all of which are known."""

    def __init__(self, g: np.ndarray, values: np.ndarray):
        order = np.argsort(g)
        self.g, self.values = g[order], values[order]
        # A slot without a 4-gram of its own shows the first one with its right value.
        self.keys = np.full(1 << SLOT_BITS, self.g[0] if len(g) else 0, dtype=np.uint64)
        self.held = np.full(1 << SLOT_BITS, self.values[0] if len(g) else 0.0)
        at = _slots(self.g)
        self.keys[at], self.held[at] = self.g, self.values

    def total(self, g: np.ndarray) -> float:
        at = _slots(g)
        out, miss = self.held[at], self.keys[at] != g
        if miss.any():
            out[miss] = self.values[np.searchsorted(self.g, g[miss])]
        return float(out.sum())


def packed(rows: DataFrame, block_col: str) -> DataFrame:
    """(block, data): the rows of each block in compressed runs; their last column is the block."""

    def seal(block: int, parts: list[pa.Table]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.concat_tables(parts).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def run(batches):
        held: dict[int, tuple[list, int]] = {}
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.num_columns - 1).to_numpy()
            order = np.argsort(keys, kind="stable")
            table = pa.Table.from_batches([b.select(range(b.num_columns - 1))])
            cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                block, part = int(keys[order[lo]]), table.take(pa.array(order[lo:hi]))
                parts, n = held.get(block, ([], 0))
                held[block] = ([*parts, part], n + part.nbytes)
                total += part.nbytes
                full = list(held) if total > HELD_BYTES else [block] if held[block][1] > PACK_BYTES else []
                for k in full:
                    parts, n = held.pop(k)
                    total -= n
                    yield seal(k, parts)
        for block, (parts, _) in held.items():
            yield seal(block, parts)

    names = [c for c in rows.columns if c != block_col]
    return rows.select(*[F.col(f"`{c}`") for c in names], F.col(block_col)).mapInArrow(tidied(run), "block long, data binary")


def unpacked(packs: pa.Table):
    for data in packs["data"]:
        with pa.ipc.open_stream(data.as_buffer()) as stream:
            yield from stream


def gram_counts(packs: DataFrame, good: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """(block, g, c): the 4-grams of each block and how often its trusted documents hold them.

    good: (block, id) of the trusted documents."""

    def run(key, left, right):
        tally, trusted = Tally(), set(right["id"].to_pylist())
        waiting: list[tuple[list, int]] = [([], 0), ([], 0)]
        for b in unpacked(left):
            for i, t in zip(b.column(id_at).to_pylist(), b.column(text_at), strict=True):
                kind = int(i is not None and i in trusted)
                for g in grams(t.as_py() or ""):
                    parts, n = waiting[kind]
                    parts.append(g)
                    waiting[kind] = (parts, n + len(g))
                    if waiting[kind][1] >= STEP_CHARS:
                        tally.add(np.concatenate(parts), kind)
                        waiting[kind] = ([], 0)
        for kind, (parts, _) in enumerate(waiting):
            if parts:
                tally.add(np.concatenate(parts), kind)
        g, n = tally.result()
        return pa.Table.from_arrays([pa.array(np.full(len(g), key[0].as_py(), np.int64)), pa.array(g.view(np.int64)), pa.array(n)], names=["block", "g", "c"])

    return packs.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(tidied(run), "block long, g long, c long")


def _last(g: Column, n: int) -> Column:
    """The last n units of an n-gram."""
    return g if n == ORDER else g.bitwiseAND(F.lit((1 << 16 * n) - 1))


def _context(g: Column) -> Column:
    return F.shiftrightunsigned(g, 16)


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, p): the interpolated modified Kneser-Ney probability of each wanted 4-gram's last unit
    after the others.  counts: (g, c) of trusted text; wanted: (g), distinct."""
    levels, level = {}, counts
    for n in range(ORDER, 0, -1):
        # Below the top an n-gram counts for the different units seen before it.
        if n < ORDER:
            level = level.groupBy(_last(F.col("g"), n).alias("g")).agg(F.count("*").alias("c"))
        level, _ = materialize(level.select("g", "c"), f"counts{n}")
        k = level.groupBy().agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
        y = k.n1 / (k.n1 + 2 * k.n2) if k.n1 else 0.0
        # Chen and Goodman's three discounts; where a count of counts is missing, one half of the count.
        ds = [min(max(i - (i + 1) * y * k[f"n{i + 1}"] / k[f"n{i}"], 0.0), float(i)) if y and k[f"n{i}"] and k[f"n{i + 1}"] else i / 2 for i in (1, 2, 3)]
        d = F.when(F.col("c") == 1, ds[0]).when(F.col("c") == 2, ds[1]).otherwise(ds[2])
        own = level.withColumns({"h": _context(F.col("g")), "d": d})
        totals = own.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        levels[n] = own.join(totals, "h").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own")), totals.select("h", "weight")
    lower = None
    for n in range(1, ORDER + 1):
        need = wanted if n == ORDER else wanted.select(_last(F.col("g"), n).alias("g")).distinct()
        own, weights = levels[n]
        out = need.withColumn("h", _context(F.col("g"))).join(own, "g", "left").join(weights, "h", "left")
        if n > 1:
            out = out.withColumn("s", _last(F.col("g"), n - 1)).join(lower.toDF("s", "below"), "s")
        else:
            out = out.withColumn("below", F.lit(1.0 / UNITS))
        # An unseen context leaves all to the lower order.
        lower, _ = materialize(out.select("g", (F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")), f"probabilities{n}")
    return lower


def fresh(name: str, taken) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def score(packs: DataFrame, known: DataFrame, schema: T.StructType, text_at: int, into: str, keep_text: bool = True) -> DataFrame:
    """The packed rows (of such a schema) with a struct column `into`: log_ppl (mean negative log
    probability of a character, null without characters) and chars.

    known: (block, g, p), the probability of every 4-gram of each block."""
    kept = [i for i in range(len(schema)) if keep_text or i != text_at]

    def run(key, left, right):
        look = Lookup(right["g"].to_numpy().view(np.uint64), np.log(right["p"].to_numpy()))
        out = []
        for b in unpacked(left):
            mean, n = [], []
            for t in b.column(text_at):
                sums = [(len(g), look.total(g)) for g in grams(t.as_py() or "")]
                n.append(sum(k for k, _ in sums))
                mean.append(-sum(s for _, s in sums) / n[-1] if n[-1] else None)
            made = pa.StructArray.from_arrays([pa.array(mean, pa.float64()), pa.array(n, pa.int64())], names=["log_ppl", "chars"])
            out.append(pa.Table.from_arrays([*(b.column(i) for i in kept), made], names=[*(schema[i].name for i in kept), into]))
        return pa.concat_tables(out)  # every block in known has rows

    fields = T.StructType([*(schema[i] for i in kept), T.StructField(into, T.StructType([T.StructField("log_ppl", T.DoubleType()), T.StructField("chars", T.LongType())]))])
    return packs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(tidied(run), fields)


def steady(score: Column, chars: Column, middle: Column) -> Column:
    return middle + F.least(chars / F.lit(float(STEADY_CHARS)), F.lit(1.0)) * (score - middle)


def folds(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids that are counted, and those that calibrate."""
    last = F.pmod(F.xxhash64("id"), F.lit(CALIBRATE)) == CALIBRATE - 1
    return trusted.where(~last), trusted.where(last)


def limits(scores: DataFrame, calibrating: DataFrame) -> tuple[DataFrame, float | None, float | None]:
    """(lang, mid, limit) of each language with calibrating documents, and mid and limit of them all;
    scores: (id, lang, log_ppl, chars), calibrating: their ids.  Bounded sketches, exact for up to a
    thousand documents."""
    known, _ = materialize(scores.join(calibrating.hint("merge"), "id", "left_semi").where("log_ppl IS NOT NULL"), "calibrating")
    q = lambda c, at: F.percentile_approx(c, F.lit(at), F.lit(10_000))
    middles = known.where("lang IS NOT NULL").groupBy("lang").agg(q("log_ppl", 0.5).alias("mid"))
    own = known.join(F.broadcast(middles), "lang")  # one row for each language
    own = own.groupBy("lang").agg(F.first("mid").alias("mid"), q(steady(F.col("log_ppl"), F.col("chars"), F.col("mid")), UPPER).alias("limit"))
    mid = known.agg(q("log_ppl", 0.5)).first()[0]
    limit = known.agg(q(steady(F.col("log_ppl"), F.col("chars"), F.lit(mid).cast("double")), UPPER)).first()[0]
    return materialize(own, "quality-limits")[0], mid, limit


def judged(docs: DataFrame, labels: DataFrame, into: str = "verdict", keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """docs with a struct column `into` (log_ppl, chars, threshold, keep), one row for each row.

    Trusted are the documents that `labels` gives quality 1.  A document is kept unless its
    log-perplexity is beyond its language's threshold; a language without calibrating documents, and
    a null one, takes the threshold of all.  Null and empty texts have no perplexity and are kept, as
    they show nothing bad; short ones are drawn towards the median.  Without any calibrating document
    nothing is rejected.  Null ids are never trusted, repeated rows count as often as they occur, other
    columns pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    good = labels.where(F.col(label_col) == 1).select(F.col(label_id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    counted, calibrating = folds(good)
    tmp, lang, ident, block = fresh("_score", [*docs.columns, into]), fresh("_lang", docs.columns), fresh("_id", docs.columns), fresh("_block", docs.columns)
    base = docs.withColumns({text_col: F.col(text_col).cast("string"), ident: F.col(id_col).cast("long")})
    schema, text_at = base.schema, base.columns.index(text_col)
    chars = base.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = F.lit(chars // BLOCK_CHARS + 1)
    # Rows that share an id go to SALT blocks, by the part of the scan that they stand in.
    own = F.pmod(F.when(F.col(ident).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(ident, F.pmod(F.spark_partition_id(), F.lit(SALT)))), blocks)
    parts = F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("part")
    trusted = counted.select("id", parts).select(F.pmod(F.xxhash64("id", "part"), blocks).alias("block"), "id").distinct()
    with scratch_scope(spark) as scope:
        packs = packed(base.withColumn(block, own), block)
        counts, _ = materialize(gram_counts(packs, trusted, len(schema) - 1, text_at), "block-grams")
        sums, _ = materialize(counts.groupBy("g").agg(F.sum("c").alias("c")), "grams")
        known = counts.select("block", "g").join(probabilities(sums.where("c > 0"), sums.select("g")), "g").select("block", "g", "p")
        scored, scored_path = materialize(score(packs, known, schema, text_at, tmp, keep_text), "perplexity")
        narrow = scored.select(F.col(ident).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(f"{tmp}.log_ppl").alias("log_ppl"), F.col(f"{tmp}.chars").alias("chars"))
        marks, mid_all, limit_all = limits(narrow, calibrating)
        marks = marks.select(F.col("lang").alias(lang), F.struct("mid", "limit").alias(fresh("_own", docs.columns)))
        out = scored.join(F.broadcast(marks), scored[lang_col].cast("string") == marks[lang], "left")  # one row for each language
        mark = out[marks.columns[1]]
        mid, limit = F.coalesce(mark["mid"], F.lit(mid_all).cast("double")), F.coalesce(mark["limit"], F.lit(limit_all).cast("double"))
        ppl, n = out[tmp]["log_ppl"], out[tmp]["chars"]
        verdict = F.struct(ppl.alias("log_ppl"), n.alias("chars"), limit.alias("threshold"), F.coalesce(steady(ppl, n, mid) <= limit, F.lit(True)).alias("keep"))
        out = out.select(*[scored[f"`{c}`"] for c in docs.columns if keep_text or c != text_col], verdict.alias(into))
        if not keep_text:
            return finished(out, "quality", scope)
        # With their texts the rows are too many for one more copy: the table of scores stays.
        needed = [p for p in scope if p == scored_path or "quality-limits" in p]
        remove(spark, *[p for p in scope if p not in needed])
        scope[:] = needed
        return out


def keep_good(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The documents that are not rejected, with their columns: judged() says which; null and empty
    texts, null ids and repeated rows stay or go by the same rule.  names: as those of judged()."""
    mark = fresh("_verdict", docs.columns)
    return judged(docs, labels, into=mark, **names).where(F.col(f"{mark}.keep")).drop(mark)
