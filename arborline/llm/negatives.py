"""Hard negatives by blocked dense products of anchors and candidates.

Candidates lie in packed blocks, which stay where they are.  Anchors are broadcast in waves of bounded
size; each task multiplies its candidate blocks with blocks of the wave's anchors in float64, which is
exact below 2^53 (integers are used beyond), and keeps the best rows of every anchor as it goes: a
state that merges in any order.  The first pass gives each anchor its best rows of the same label, the
second, with a window of scores for each of these, the best rows of other labels within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .common import finished, materialize, scratch_scope, tidied
from .topk import exact_products

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these shares of the positive's, in percent.
LEAST, MOST = 50, 95
#: Bytes of anchors in one broadcast, and anchors multiplied with a block at once.
WAVE_BYTES, ANCHOR_ROWS = 32 << 20, 256
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The k best (score, id) of every query, ties to the smaller id; may be fed in any order."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), LAST)
        self.full = np.zeros((queries, k), bool)

    def feed(self, first: int, ok: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows `first`... of the queries meet columns of scores where ok."""
        span = slice(first, first + len(scores))
        kth, kid, full = self.score[span, -1:], self.id[span, -1:], self.full[span, -1:]
        row, col = np.nonzero(ok & (~full | (scores > kth) | ((scores == kth) & (ids < kid))))
        if not len(row):
            return
        s, i = scores[row, col], ids[col]
        touched = np.unique(row)
        r, j = np.nonzero(self.full[span][touched])
        row = np.concatenate([row, touched[r]])
        s = np.concatenate([s, self.score[span][touched[r], j]])
        i = np.concatenate([i, self.id[span][touched[r], j]])
        order = np.lexsort((i, ~s, row))  # ~s falls as s rises, and cannot wrap
        row, s, i = row[order], s[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        for name, v in (("score", s), ("id", i), ("full", np.ones(len(s), bool))):
            getattr(self, name)[first + row[keep], place[keep]] = v[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.full)
        return q, self.score[q, j], self.id[q, j]


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest n with LEAST * score <= 100 * n <= MOST * score, in Python's integers."""
    p = score.astype(object)
    return -((-p * LEAST) // 100), (p * MOST) // 100


def _passed(blocks: DataFrame, anchors: dict, k: int, tag: str) -> DataFrame:
    """(anchor, slot, score, id, rank): the k best rows for a wave.  anchors: ids, labels, rows; for the
    second pass also windows (anchor, lo, hi, slot), each a query of its own."""
    spark: SparkSession = blocks.sparkSession
    sent = spark.sparkContext.broadcast(anchors)

    def run(batches):
        a = sent.value
        ids, labels, x, windows = a["ids"], a["labels"], a["rows"], a["windows"]
        best = Best(len(ids if windows is None else windows[0]), k)
        for b in batches:
            for c_ids, c_labels, m in unpacked(b):
                if m.shape[1] != x.shape[1]:
                    continue
                c_ids, c_labels, m = c_ids.to_numpy(), c_labels.to_numpy(), m.astype(np.int64)
                for lo in range(0, len(ids), ANCHOR_ROWS):
                    own = slice(lo, lo + ANCHOR_ROWS)
                    s = exact_products(x[own], m)
                    same = labels[own][:, None] == c_labels
                    if windows is None:
                        best.feed(lo, same & (ids[own][:, None] != c_ids), s, c_ids)
                        continue
                    # The windows of an anchor stand together, so those of these anchors are a run.
                    first, last = np.searchsorted(windows[0], [lo, lo + ANCHOR_ROWS])
                    for at in range(first, last, ANCHOR_ROWS):
                        w = slice(at, min(at + ANCHOR_ROWS, last))
                        of = windows[0][w] - lo
                        ws = s[of]
                        best.feed(at, ~same[of] & (ws >= windows[1][w][:, None]) & (ws <= windows[2][w][:, None]), ws, c_ids)
        q, s, i = best.rows()
        out = [ids[q], np.zeros(len(q), np.int64)] if windows is None else [ids[windows[0][q]], windows[3][q]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (*out, s, i)], names=["anchor", "slot", "score", "id"])

    found = blocks.mapInArrow(tidied(run), "anchor long, slot long, score long, id long")
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    out, _ = materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), tag)
    sent.destroy()
    return out


def hard_negatives(vectors: DataFrame, every: int = EVERY, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`, positives an anchor's five best rows of its
    label, negatives the three best rows of other labels whose score lies between 50 and 95 percent of
    the positive's; ties go to the smaller id, fewer rows give all.  Rows with a null id, label or
    vector, an empty vector, or null or non-finite components take no part; vectors of different lengths
    do not meet.  A row of the anchor's own id is no positive; other repeated rows each take a place.
    Of repeated anchors the one of the largest vector, then label, counts.  Scores beyond 64 bits are
    held at their ends.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    with scratch_scope(spark) as scope:
        known = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
        blocks, _ = materialize(packed(known, "id", "v", SCALE, "label"), "negatives-blocks")
        asked = known.where((F.col("id") % every == 0) & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        asked = asked.groupBy("id", F.size("v").alias("dim")).agg(F.max(F.struct("v", "label")).alias("top")).select("id", "top.v", "top.label")
        asks, _ = materialize(packed(asked, "id", "v", SCALE, "label", block_rows=1024).withColumn("wave_key", F.monotonically_increasing_id()), "negatives-anchors")
        # Blocks are dealt to waves by their running size; only sizes and numbers come to the driver.
        waves, size = [], {}
        for r in asks.select("wave_key", "dim", F.octet_length("data").alias("size")).orderBy("dim", "wave_key").toLocalIterator():
            if not waves or (size["dim"], True) != (r["dim"], size["bytes"] + r["size"] <= wave_bytes):
                waves.append([])
                size = {"dim": r["dim"], "bytes": 0}
            waves[-1].append(r["wave_key"])
            size["bytes"] += r["size"]
        out = None
        for keys in waves:
            # No more than WAVE_BYTES of anchors, and their few positives.
            wave = asks.where(F.col("wave_key").isin(keys)).drop("wave_key").toArrow()
            parts = [(i.to_numpy(), lab.to_numpy(), m) for b in wave.to_batches() for i, lab, m in unpacked(b)]
            ids, labels, x = (np.concatenate(v).astype(np.int64) for v in zip(*parts, strict=True))
            anchors = {"ids": ids, "labels": labels, "rows": x, "windows": None}
            positives = _passed(blocks, anchors, POSITIVES, "negatives-positives")
            p = positives.select("anchor", "rank", "score").toArrow()
            place = {i: j for j, i in enumerate(ids.tolist())}
            at = np.array([place[i] for i in p["anchor"].to_pylist()], np.int64)
            rank, score = p["rank"].to_numpy(), p["score"].to_numpy()
            order = np.lexsort((rank, at))
            lo, hi = window(score[order])
            some = np.array(lo <= hi, bool) if len(lo) else np.zeros(0, bool)  # a positive below zero allows none
            anchors["windows"] = (at[order][some], lo[some].astype(np.int64), hi[some].astype(np.int64), rank[order][some].astype(np.int64))
            found = _passed(blocks, anchors, NEGATIVES, "negatives-found").select("anchor", "slot", F.col("rank").alias("place"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
            rows = found.join(positives.select("anchor", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"])
            rows = rows.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return finished(out, "negatives", scope)
