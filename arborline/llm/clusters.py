"""Centroid clustering of quantized vectors, exact in every round.

Each pass screens all centroids by one float32 matrix product a block.  The squared distance less
|x|^2 is |c|^2 - 2 x.c; the product's rounding error is at most g |x| |c| with g = n u / (1 - n u),
u = 2^-24 and n two more than the components (rounding the factors to float32 included), in whatever
order the terms are summed.  That gives an interval for every centroid.  Where the lowest interval
overlaps no other, its centroid is the nearest for certain; where some overlap, those centroids are
compared by exact integers, ties going to the smaller number.

A round's sums are added up within each task, then by Spark, as two halves that cannot overflow; the
driver gets one row for each centroid and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import matrix, packed, unpacked
from .common import finished, materialize, scratch_scope, tidied

SCALE, DIM, CENTROIDS, ROUNDS = 1024, 64, 8, 10
#: Unit roundoff of float32, and a relative margin for the float64 arithmetic of the bounds.
U32, MARGIN = 2.0**-24, 2.0**-48
MOST = 2**63 - 1


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to rows c of the same number: 64-bit integers where they suffice, Python's elsewhere."""
    reach = float(np.abs(x.astype(np.float64)).max(initial=0)) + float(np.abs(c.astype(np.float64)).max(initial=0))
    if reach * reach * x.shape[1] < 2.0**62:
        d = x.astype(np.int64) - c.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def screened(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether each centroid may be the nearest one of each row, by the float32 intervals."""
    dim = x.shape[1]
    xd, cd = x.astype(np.float64), centroids.astype(np.float64)
    if float(np.abs(xd).max(initial=0)) * float(np.abs(cd).max(initial=0)) * dim >= 2.0**120:
        return np.ones((len(x), len(centroids)), bool)  # float32 might overflow
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    n = dim + 2
    squares = (cd * cd).sum(axis=1)
    lengths = np.sqrt((xd * xd).sum(axis=1))[:, None] * np.sqrt(squares)
    middle = squares - 2 * product
    slack = 2 * lengths * (n * U32 / (1 - n * U32)) * (1 + MARGIN * n) + (squares + 2 * np.abs(product) + np.abs(middle)) * (MARGIN * n)
    return middle - slack <= (middle + slack).min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(the nearest centroid of each row, rows that the intervals left open)."""
    may = screened(x, centroids)
    found = may.argmax(axis=1)
    several = np.flatnonzero(may.sum(axis=1) > 1)
    if len(several):
        row, k = np.nonzero(may[several])
        d = exact_distances(x[several[row]], centroids[k])
        first = np.full(len(several), -1)
        best = np.zeros(len(several), dtype=d.dtype)
        for c in range(len(centroids)):  # in the centroids' order, so that the smaller number keeps a tie
            at = k == c
            r, v = row[at], d[at]
            take = (first[r] < 0) | (v < best[r])
            first[r[take]], best[r[take]] = c, v[take]
        found[several] = first
    return found, len(several)


def column_sums(x: np.ndarray) -> list[int]:
    top = int(np.abs(x.astype(np.float64)).max(initial=0))
    return [int(v) for v in (x.astype(np.int64).sum(axis=0) if top * max(len(x), 1) < 2**62 else x.astype(object).sum(axis=0))]


def seeds(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> np.ndarray:
    """The k usable vectors of the least sha256 of 3:<id>, in that order; repeated ids by their vectors, null ids last."""
    first = vectors.select(F.sha2(F.concat(F.lit("3:"), F.col(id_col).cast("long").cast("string")), 256).alias("h"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    usable = (F.size("v") == DIM) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = first.where(F.coalesce(usable, F.lit(False))).orderBy(F.asc_nulls_last("h"), "v").limit(k)  # k rows in the end
    rows = packed(top.coalesce(1), "id", "v", SCALE, dim=DIM).toArrow().to_pylist()
    return np.concatenate([np.zeros((0, DIM), np.int64), *(matrix(r["data"], r["n"], r["dim"], r["wide"]).astype(np.int64) for r in rows)])


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of each one's vectors; those without any stay."""
    dim = centroids.shape[1]

    def run(batches):
        sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
        for b in batches:
            for _, _, x in unpacked(b):
                near, _ = nearest(x, centroids)
                for c in np.unique(near).tolist():
                    own = x[near == c]
                    counts[c] += len(own)
                    sums[c] = [a + b for a, b in zip(sums[c], column_sums(own), strict=True)]
        out = [(c, n, i, s >> 32, s & 0xFFFFFFFF) for c, n in enumerate(counts) if n for i, s in enumerate(sums[c])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["c", "n", "i", "hi", "lo"])

    big = lambda name: F.sum(F.col(name).cast("decimal(19,0)")).alias(name)
    total = blocks.mapInArrow(tidied(run), "c long, n long, i long, hi long, lo long").groupBy("c", "i").agg(big("n"), big("hi"), big("lo"))
    out = centroids.copy()
    for r in total.collect():  # a row for each centroid and component
        out[r["c"], r["i"]] = ((int(r["hi"]) << 32) + int(r["lo"])) // int(r["n"])
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): distances beyond 64 bits are held at their end."""

    def run(batches):
        for b in batches:
            for ids, _, x in unpacked(b):
                near, _ = nearest(x, centroids)
                d = exact_distances(x, centroids[near])
                d = d if d.dtype != object else np.array([min(v, MOST) for v in d], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(tidied(run), "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    Vectors with exactly 64 components, none null or non-finite, take part; all others are left out.
    Repeated rows each count.  Rows with a null id take part and keep it, but are chosen as a first
    centroid only where fewer than k others exist; with fewer than k vectors there are as many
    centroids as vectors.  Components beyond 64 bits are held at their ends, as are distances and
    their sums; sums of components are exact at any size.  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark: SparkSession = vectors.sparkSession
    with scratch_scope(spark) as scope:
        blocks, _ = materialize(packed(vectors, id_col, vec_col, SCALE, dim=DIM), "cluster-blocks")
        centroids = seeds(vectors, k, id_col, vec_col)
        if not len(centroids):
            return finished(spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), "clusters", scope)
        for _ in range(rounds):
            after = moved(blocks, centroids)
            if (after == centroids).all():
                break  # every further round repeats this one
            centroids = after
        rows, _ = materialize(assigned(blocks, centroids), "cluster-rows")
        sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
        about = [(c, min(s, MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
        about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        # At most k rows.
        return finished(rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters", scope)
