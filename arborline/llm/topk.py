"""Exact top-k by integer inner product over KD-trees, one for each shard.

A shard is a run of rows of one scan partition.  Its tree splits at the median of the widest
coordinate and keeps the tight bounding box of every node; the largest inner product that a box
allows bounds what a query can find there.  Queries are searched in blocks, best node first.

Only boxes meet at first: the box of each block of queries with the root box of each shard, which
orders a block's shards by what they may hold.  The search then goes in rounds, the most promising
shards first and eight times as many in each round.  After each round the k-th scores are carried
on, and shards whose root box cannot reach them are never sent.  Bounds are doubles rounded
outward; scores are exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finished, materialize, scratch_scope, tidied

SCALE = 1024
#: Rows of a shard, of a leaf, and of a block of queries.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 512, 512
#: Blocks that meet a shard in one task, how many times more shards each round takes, and shards whose
#: boxes meet those of the blocks in one part.
GROUP_BLOCKS, GROWTH, PART_SHARDS = 32, 8, 64
NONE = np.iinfo(np.int64).min
#: Relative margin by which doubles are rounded outward, for each term of a sum.
MARGIN = 2.0**-50


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component; vectors with null or non-finite components, and
    null or empty vectors, are left out, as are null ids."""
    v = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) for each vector length of a batch."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[start[rows][:, None] + np.arange(d)].astype(np.int64)))
    return out


def _pack(ids: np.ndarray, m: np.ndarray) -> bytes:
    return np.int64([m.shape[1]]).tobytes() + ids.astype(np.int64).tobytes() + np.ascontiguousarray(m, dtype=np.int64).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, dtype=np.int64)
    d = int(a[0])
    n = (len(a) - 1) // (d + 1)
    return a[1 : n + 1], a[n + 1 :].reshape(n, d)


def blocks(vectors: DataFrame, rows: int, number: str) -> DataFrame:
    """(number, dim, lo, hi, data): the quantized rows in runs of at most so many, each run of one
    length, with a number of its own (of its partition and place) and its bounding box."""
    names = [number, "dim", "lo", "hi", "data"]

    def row(k: int, i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        from pyspark import TaskContext

        box = [pa.array([v.astype(np.float64).tolist()], pa.list_(pa.float64())) for v in (x.min(axis=0), x.max(axis=0))]
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()), pa.array([x.shape[1]], pa.int32()), *box, pa.array([_pack(i, x)], pa.binary())], names=names)

    def run(batches):
        held: dict[int, tuple[list, list, int]] = {}
        k = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, m in _matrix(b.column(1)):
                for lo in range(0, len(at), rows):
                    i, x, n = held.get(m.shape[1], ([], [], 0))
                    i, x, n = [*i, ids[at[lo : lo + rows]]], [*x, m[lo : lo + rows]], n + len(at[lo : lo + rows])
                    if n >= rows:
                        i, x = np.concatenate(i), np.concatenate(x)
                        yield row(k, i[:rows], x[:rows])
                        k += 1
                        i, x, n = [i[rows:]], [x[rows:]], n - rows
                    held[m.shape[1]] = (i, x, n)
        for i, x, n in held.values():
            if n:
                yield row(k, np.concatenate(i), np.concatenate(x))
                k += 1

    return vectors.mapInArrow(tidied(run), f"{number} long, dim int, lo array<double>, hi array<double>, data binary")


def exact_products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the ends of 64 bits: doubles where every sum is below 2^53
    and so exact, 64-bit integers below 2^62, Python's integers elsewhere."""
    big = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * q.shape[1]
    if big < 2**53:
        return (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if big < 2**62:
        return q @ rows.T
    found = np.clip(q.astype(object) @ rows.astype(object).T, -(2**63), 2**63 - 1)
    return found.astype(np.int64)


class KdTree:
    """Median splits with tight boxes; nodes are index ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.lo, self.hi, self.kids, self.span = [], [], [], []

        def node(a: int, b: int) -> int:
            own = m[order[a:b]]
            at = len(self.span)
            self.lo.append(own.min(axis=0))
            self.hi.append(own.max(axis=0))
            self.span.append((a, b))
            self.kids.append(())
            wide = self.hi[at] - self.lo[at]
            if b - a > leaf and wide.max() > 0:
                mid, axis = (a + b) // 2, int(wide.argmax())
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid - a)]
                self.kids[at] = (node(a, mid), node(mid, b))
            return at

        node(0, len(ids))
        self.ids, self.rows = ids[order], m[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        """The (ids, scores) of each query's k best here, of those that may still reach its k-th
        score, and the k-th scores now known."""
        # The most that a box allows, queries by nodes, rounded up; scores end at 64 bits.
        qf, lo, hi = q.astype(np.float64), self.lo.astype(np.float64), self.hi.astype(np.float64)
        bound = np.maximum(qf, 0) @ hi.T + np.minimum(qf, 0) @ lo.T
        bound += (np.abs(qf) @ np.maximum(np.abs(lo), np.abs(hi)).T) * (MARGIN * q.shape[1]) + 1
        bound = np.clip(bound, -(2.0**63), 2.0**63)
        kth = kth.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        heap = [(-bound[:, 0].max(), 0)]
        while heap:
            _, at = heapq.heappop(heap)
            # Equal scores may win by a smaller id, so only a smaller bound is out of reach.
            live = np.flatnonzero(bound[:, at] >= kth.astype(np.float64) * np.where(kth > 0, 1 - MARGIN, 1 + MARGIN))
            if not len(live):
                continue
            if self.kids[at]:
                for kid in self.kids[at]:
                    heapq.heappush(heap, (-bound[live, kid].max(), kid))
                continue
            a, b = self.span[at]
            ids, scores = self.ids[a:b], exact_products(q[live], self.rows[a:b])
            for row, s in zip(live, scores, strict=True):
                hit = np.flatnonzero((s >= kth[row]) & (ids != q_ids[row]))
                if len(hit):
                    i, v = np.concatenate([best[row][0], ids[hit]]), np.concatenate([best[row][1], s[hit]])
                    top = np.lexsort((i, ~v))[:k]  # ~v falls as v rises, and cannot wrap
                    best[row] = (i[top], v[top])
                    if len(top) == k:
                        kth[row] = max(kth[row], v[top[-1]])
        return best, kth


def _search(k: int):
    """From one shard, and some of the blocks that may find something there: their best rows."""
    names, types = ["block", "query_id", "vec_id", "score"], (pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(left, right):
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            tree = KdTree(*_unpack(left["data"][0].as_py()))
            for j in range(right.num_rows):
                q_ids, q = _unpack(right["data"][j].as_py())
                known = dict(right["kths"][j].as_py() or ())
                start = np.array([known.get(i, NONE) for i in q_ids.tolist()], dtype=np.int64)
                best, _ = tree.search(q_ids, q, start, k)
                n = [len(i) for i, _ in best]
                for c, x in zip(out, (np.full(sum(n), right["block"][j].as_py()), np.repeat(q_ids, n), np.concatenate([i for i, _ in best]), np.concatenate([v for _, v in best])), strict=True):
                    c.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def box_bound(qlo: Column, qhi: Column, lo: Column, hi: Column) -> Column:
    """The largest inner product of a vector in one box with one in another, rounded up."""
    corner = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    top = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: F.greatest(x, y))
    corners = [corner(a, b) for a in (qlo, qhi) for b in (lo, hi)]
    most = top(top(corners[0], corners[1]), top(corners[2], corners[3]))
    far = [F.transform(x, lambda y: F.abs(y)) for x in corners]
    size = top(top(far[0], far[1]), top(far[2], far[3]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(total(most) + total(size) * F.size(qlo) * F.lit(MARGIN) + 1, F.lit(-(2.0**63)))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(block, query_id, vec_id, score, rank): each query's k best rows, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query (ids divisible by `every`).

    Candidates are all other rows (rows of the query's own id are none); ties go to the smaller
    id; fewer than k candidates give them all.  Vectors that are null, empty, or hold null or
    non-finite components, and null ids, take no part; vectors of different lengths do not meet.
    Components beyond 64 bits, and scores beyond them, are held at their ends.  Repeated candidate
    rows each take a place; a query row that is repeated counts once, with the vector of its largest
    components where they differ.  Other columns are ignored; an empty table gives an empty result.
    """
    with scratch_scope(vectors.sparkSession) as scope:
        rows = quantized(vectors, id_col, vec_col)
        asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
        shards, _ = materialize(blocks(rows, SHARD_ROWS, "shard"), "topk-shards")
        queries, _ = materialize(blocks(asked, BLOCK_QUERIES, "block"), "topk-blocks")
        # Boxes only; a block's shards are ordered by their bounds.  All vectors may have one length, so the
        # shards' boxes are dealt in parts, to each of which every block's box goes.
        parts = -(-shards.count() // PART_SHARDS) or 1
        each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        asked_boxes = queries.select("dim", "block", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), each)
        boxes = asked_boxes.join(shards.select("dim", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part"), "shard", "lo", "hi"), ["dim", "part"])
        pairs = boxes.select("block", "shard", box_bound(F.col("qlo"), F.col("qhi"), F.col("lo"), F.col("hi")).alias("bound"))
        order = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
        pairs, _ = materialize(pairs.withColumn("place", F.row_number().over(order) - 1), "topk-pairs")
        size = pairs.agg(F.max("place"), F.count_distinct("block")).first()
        last, groups = size[0], -(-size[1] // GROUP_BLOCKS) if size[1] else 1
        best, lo, hi = None, 0, 1
        while last is not None and lo <= last:
            here = pairs.where(F.col("place").between(lo, hi - 1))
            asks = queries.select("block", "data")
            if best is not None:
                # A query's k-th score, and the least of a block: a shard whose box stays below it has nothing for the block.
                kth = best.groupBy("block", "query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
                blocks_kth = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("kths"), F.min("kth").cast("double").alias("least"), F.count("*").alias("known"))
                asks = queries.select("block", "data", "dim").join(blocks_kth, "block", "left")
                asks = asks.withColumn("least", F.when(F.col("known") == F.expr("(octet_length(data) div 8 - 1) div (dim + 1)"), F.col("least") - F.abs("least") * MARGIN))
                here = here.join(asks.select("block", "least"), "block").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("block", "shard")
            else:
                asks = asks.withColumn("kths", F.lit(None).cast("map<long,long>"))
            here = here.select("block", "shard", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("part"))
            here, _ = materialize(here, f"topk-round{lo}")
            sent = here.join(asks.select("block", "data", "kths"), "block")
            shipped = here.select("shard", "part").distinct().join(shards.select("shard", "data"), "shard").toDF("to", "slice", "data")
            found = shipped.groupBy("to", "slice").cogroup(sent.groupBy("shard", "part")).applyInArrow(tidied(_search(k)), "block long, query_id long, vec_id long, score long")
            found = found if best is None else found.unionByName(best)
            best, _ = materialize(best_of(found, k).drop("rank"), f"topk-best{lo}")
            lo, hi = hi, hi * GROWTH
        if best is None:
            best = vectors.sparkSession.createDataFrame([], "block long, query_id long, vec_id long, score long")
        return finished(best_of(best, k).select("query_id", "rank", "vec_id", "score"), "topk", scope)
