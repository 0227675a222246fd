"""Vectors as arrays of doubles: norms, means by group and up the tree, variance, nearest class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import new_path, written
from ..sources.files import opened

#: Below this a norm counts as this much (the clamping contract).
TINY = 1e-12
#: Bytes of the class matrix that a task holds at once, rows of a tile of a blocked product, and
#: parts in which sums of matrices are brought together.
CLASS_BYTES, TILE_ROWS, PARTS = 64 << 20, 2048, 32
#: Rows that meet the classes together.
ROWS_TOGETHER = 1 << 16
#: Pivots of a block, parts by the angle to the first, and what angles may be wrong by.
PIVOTS, ANGLE_PARTS, ANGLE_ERROR = 3, 32, 1e-6


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix; nulls among them raise, as do vectors of different lengths."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if column.null_count or (size != (size[0] if len(size) else 0)).any():
        raise ValueError("vectors are null or of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(size), -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, clamp: bool = True) -> Column:
    """v over its norm.  clamp: zero vectors stay zero; otherwise they become NaN."""
    n = F.greatest(norm(v), F.lit(TINY)) if clamp else F.when(norm(v) > 0, norm(v)).otherwise(F.lit(float("nan")))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_sums(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, s, n): the sum of the vectors of each group and their number.

    Each Arrow batch is summed as a matrix, one row for each of its groups; the partial sums of a group
    then meet one after the other, so that no task holds more than two of them.  Null vectors are left
    out.  Keys are compared as Spark compares them, nulls are a group of their own.
    """
    kinds = [rows.schema[k] for k in keys]
    schema = T.StructType([*(T.StructField(k.name, k.dataType) for k in kinds), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(len(keys)))
                code = b.select(range(len(keys))).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(x), np.int64)
                order = np.argsort(code, kind="stable")
                start = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums, n = np.add.reduceat(x[order], start, axis=0), np.diff(np.append(start, len(order)))
                first = pa.array(order[start])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(first) for k in range(len(keys))), pa.array(list(sums), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=schema.names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n, head = None, 0, None
        for b in batches:
            if b.num_rows:
                head = b.slice(0, 1) if head is None else head
                x = matrix_of(b.column(len(keys))).sum(axis=0)
                s, n = x if s is None else s + x, n + sum(b.column(len(keys) + 1).to_pylist())
        if head is not None:
            yield pa.RecordBatch.from_arrays([*(head.column(k) for k in range(len(keys))), pa.array([s], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=schema.names)

    parts = rows.where(F.col(vec).isNotNull()).select(*keys, F.col(vec).cast("array<double>").alias("_v")).mapInArrow(partial, schema)
    if not keys:
        return parts.repartition(1).mapInArrow(total, schema)
    return parts.groupBy(*keys).applyInArrow(total, schema)


def group_mean(rows: DataFrame, keys: list[str], vec: str, name: str = "mean") -> DataFrame:
    """Element-wise mean by group."""
    return vector_sums(rows, keys, vec).select(*keys, F.transform("s", lambda x: x / F.col("n")).alias(name))


def roll_up(leaf_means: DataFrame, ranks: list[str], vec: str = "mean") -> DataFrame:
    """(depth, key, mean): every leaf weighs one in each of its ancestors, and in the root: one pass, in
    which a leaf goes to all of its nodes."""
    nodes = [F.struct(F.lit(depth).alias("depth"), (F.concat_ws("|", *ranks[: depth + 1]) if depth >= 0 else F.lit("")).alias("key")) for depth in range(-1, len(ranks))]
    keyed = leaf_means.select(F.explode(F.array(*nodes)).alias("node"), vec).select("node.depth", "node.key", vec)
    return group_mean(keyed, ["depth", "key"], vec)


def variance_split(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """Total, within and between variance (weighted by rows, and by classes), from each class's number of
    rows, sum and sum of squared lengths about a point near the mean: rows are not joined with means.

    The point (the mean of a few rows) keeps the differences of large sums exact enough."""
    near = group_mean(rows.where(F.col(vec).isNotNull()).limit(1000), [], vec, "_o")
    # One row, the same in every later use.
    near = rows.sparkSession.createDataFrame(near.collect(), near.schema)
    moved = rows.where(F.col(vec).isNotNull()).join(F.broadcast(near)).select(label, F.zip_with(vec, "_o", lambda x, o: x - o).alias("_m"))
    sums = vector_sums(moved.withColumn("_m", F.concat("_m", F.array(dot(F.col("_m"), F.col("_m"))))), [label], "_m")
    last = F.element_at("s", -1)
    per = written(sums.select(label, "n", F.slice("s", 1, F.size("s") - 1).alias("s"), last.alias("q")).withColumn("mean", F.transform("s", lambda x: x / F.col("n"))), "variance-classes")
    whole = vector_sums(per.select("s"), [], "s").select(F.col("s").alias("all"))
    centre = group_mean(per, [], "mean", "centre")
    diff = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    sq = lambda v: dot(v, v)
    per_total = per.agg(F.sum("n").alias("rows"))
    j = per.join(F.broadcast(whole)).join(F.broadcast(centre)).join(F.broadcast(per_total))  # one row each
    root = F.transform("all", lambda x: x / F.col("rows"))
    n = F.first("rows")
    total = (F.sum("q") / n - F.first(sq(root))).alias("total")
    within = (F.sum(F.col("q") - sq(F.col("mean")) * F.col("n")) / n).alias("within")
    between = (F.sum(sq(diff(F.col("mean"), root)) * F.col("n")) / n).alias("between")
    return j.agg(total, within, between, F.avg(sq(diff(F.col("mean"), F.col("centre")))).alias("between_classes"))


def nearest_class(rows: DataFrame, key: str, vec: str, classes: DataFrame, cls: str, cvec: str, most_bytes: int = CLASS_BYTES) -> DataFrame:
    """(key, class, cosine): the class of the largest cosine, ties to the smallest class.

    Classes are written in order, in files of `most_bytes` at most; one scan of the rows takes ROWS_TOGETHER
    of them at a time past these files, a matrix product for each, and keeps the best so far.  No class
    goes through the driver, and a task holds one file.
    """
    spark = rows.sparkSession
    kind, key_kind = (df.schema[x].dataType for df, x in ((classes, cls), (rows, key)))
    schema = T.StructType([T.StructField(key, key_kind), T.StructField(cls, kind), T.StructField("cosine", T.DoubleType())])
    size = classes.agg(F.count("*").alias("n"), F.max(F.size(cvec)).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    each = max(1, most_bytes // (8 * (size["d"] or 1)))
    path = new_path(spark, "classes")
    # Names of files follow the order of the classes.
    ordered = classes.select(cls, normalized(F.col(cvec)).alias("_c")).repartitionByRange(max(1, -(-size["n"] // each)), cls).sortWithinPartitions(cls)
    ordered.write.option("maxRecordsPerFile", each).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet as pq

        def best_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = matrix_of(t.column(1).combine_chunks())
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)
            top, name = np.full(len(x), -np.inf), np.empty(len(x), dtype=object)
            for uri in files:
                store, at = opened(uri)
                with store.open_input_file(at) as f:
                    block = pq.read_table(f)
                if not block.num_rows:
                    continue
                s = x @ matrix_of(block.column("_c").combine_chunks()).T
                own = s.argmax(axis=1)  # the first of equals
                found = s[np.arange(len(s)), own]
                better = found > top
                top[better] = found[better]
                name[better] = block.column(cls).take(pa.array(own[better])).to_pylist()
            return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(name, to_arrow_type(kind)), pa.array(top)], names=[key, cls, "cosine"])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= ROWS_TOGETHER:
                yield best_of(held)
                held, n = [], 0
        if held:
            yield best_of(held)

    return rows.select(key, F.col(vec).cast("array<double>").alias("_v")).mapInArrow(score, schema)


def blocked_max_cosine(left: DataFrame, right: DataFrame, key: str, block: str, vec: str, tile: int = TILE_ROWS, least: float | None = None, sent: list | None = None) -> DataFrame:
    """(key, cosine): the largest cosine of each left row with right rows of its block; blocks that
    either side lacks give nothing.

    Both sides of a block are cut in chunks of about `tile` rows; each two chunks are one matrix product, so
    a large block is many tasks and none holds more than two chunks.  Chunks are cut by the angle to a
    pivot of the block, and each keeps the range of its angles to all PIVOTS.  Angles obey the triangle
    inequality: where two chunks' ranges to some pivot lie further apart than arccos(least), none of
    their rows reach `least`, and the tile is never sent.  least: smaller results are left out.
    sent: a list that gets the number of tiles sent and of all tiles.
    """
    kind = left.schema[key].dataType.simpleString()
    plain = lambda df: df.where(F.col(vec).isNotNull()).select(F.col(block).alias("b"), F.col(key).alias("_k"), F.col(vec).cast("array<double>").alias("_v"))
    sides = [plain(left), plain(right)]
    # A pivot is the right row of the least hash, under a seed of its own.
    pivots = sides[1].groupBy("b").agg(*[F.min_by("_v", F.xxhash64("_k", F.lit(i))).alias(f"_p{i}") for i in range(PIVOTS)], F.count("*").alias("_n"))
    near = lambda x: F.acos(F.greatest(F.least(F.coalesce(cosine(F.col("_v"), x), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))  # noqa: E731  a zero vector is at right angles to all
    angled = [s.join(pivots, "b").select("b", "_k", "_v", *[near(F.col(f"_p{i}")).alias(f"_a{i}") for i in range(PIVOTS)]) for s in sides]
    cuts = angled[1].groupBy("b").agg(F.percentile_approx("_a0", [k / ANGLE_PARTS for k in range(1, ANGLE_PARTS)], 1000).alias("_cuts"))

    def chunked(side: DataFrame) -> DataFrame:
        # Parts by angle, and chunks of those by hash where they are larger than a tile.
        parted = side.join(cuts, "b").withColumn("_part", F.size(F.filter("_cuts", lambda x: x < F.col("_a0"))))
        sizes = parted.groupBy("b", "_part").agg(F.ceil(F.count("*") / tile).cast("int").alias("_of"))
        chunk = F.struct("_part", F.pmod(F.xxhash64("_k", "_v"), F.col("_of")).cast("int").alias("n")).alias("chunk")
        return written(parted.join(sizes, ["b", "_part"]).select("b", chunk, "_k", "_v", *[f"_a{i}" for i in range(PIVOTS)]), "similarity-chunks")

    chunks = [chunked(a) for a in angled]
    about = [c.groupBy("b", F.col("chunk").alias(n)).agg(*[f(f"_a{i}").alias(f"{n}{m}{i}") for i in range(PIVOTS) for f, m in ((F.min, "lo"), (F.max, "hi"))]) for c, n in zip(chunks, "lr", strict=True)]
    tiles = about[0].join(about[1], "b")
    if sent is not None:
        sent.append(tiles.count())
    if least is not None:
        apart = [F.greatest(F.col(f"llo{i}") - F.col(f"rhi{i}"), F.col(f"rlo{i}") - F.col(f"lhi{i}")) for i in range(PIVOTS)]
        tiles = tiles.where(F.greatest(*apart, F.lit(0.0)) <= float(np.arccos(np.clip(least, -1, 1))) + ANGLE_ERROR)
    tiles = written(tiles.select("b", "l", "r"), "similarity-tiles")
    if sent is not None:
        sent.insert(0, tiles.count())
    a = chunks[0].select("b", F.col("chunk").alias("l"), "_k", "_v").join(tiles, ["b", "l"])
    b = chunks[1].select("b", F.col("chunk").alias("r"), "_k", "_v").join(tiles, ["b", "r"]).toDF("b2", "r2", "_k", "_v", "l2")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({key: pa.array([], x.schema.field("_k").type), "cosine": pa.array([], pa.float64())})
        m, n = (matrix_of(t["_v"].combine_chunks()) for t in (x, y))
        m, n = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), TINY) for t in (m, n))
        return pa.table({key: x["_k"], "cosine": (m @ n.T).max(axis=1)})

    found = a.groupBy("b", "l", "r").cogroup(b.groupBy("b2", "l2", "r2")).applyInArrow(best, f"{key} {kind}, cosine double")
    out = found.groupBy(key).agg(F.max("cosine").alias("cosine"))
    return out if least is None else out.where(F.col("cosine") >= least)


def spectrum(rows: DataFrame, vec: str) -> DataFrame:
    """Participation ratio tr(C)^2 / |C|^2, mean pairwise cosine by |sum x|^2, mean norm: moments
    only, no eigenvalues and no pairs of rows.  Each partition gives one sum of X'X; these meet in
    PARTS tasks first, one after the other."""
    schema = "part int, m array<double>, s array<double>, u array<double>, norms double, n long"
    names = ["part", "m", "s", "u", "norms", "n"]

    def row(part: int, m: np.ndarray, s: np.ndarray, u: np.ndarray, norms: float, n: int) -> pa.RecordBatch:
        lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in (m, s, u)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists, pa.array([norms]), pa.array([n], pa.int64())], names=names)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = None
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0))
                size = np.linalg.norm(x, axis=1)
                one = (x.T @ x, x.sum(axis=0), (x / np.maximum(size, TINY)[:, None]).sum(axis=0), float(size.sum()), len(x))
                got = one if got is None else tuple(p + q for p, q in zip(got, one, strict=True))
        if got is not None:
            yield row(TaskContext.get().partitionId() % PARTS, *got)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for b in batches:
            for k in range(b.num_rows):
                one = tuple(np.array(b.column(i)[k].as_py()) for i in range(1, 4)) + (b.column(4)[k].as_py(), b.column(5)[k].as_py())
                got = one if got is None else tuple(p + q for p, q in zip(got, one, strict=True))
        if got is not None:
            yield row(0, *got)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in total(batches):
            m, s, u = (np.array(b.column(i)[0].as_py()) for i in range(1, 4))
            norms, n = b.column(4)[0].as_py(), b.column(5)[0].as_py()
            mu = s / n
            c = m.reshape(len(s), len(s)) / n - np.outer(mu, mu)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.trace(c) ** 2 / (c * c).sum())]), pa.array([float((u @ u - n) / (n * (n - 1)))] if n > 1 else [None], pa.float64()), pa.array([norms / n])], names=["participation", "mean_cosine", "mean_norm"])

    parts = rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("_v")).mapInArrow(moments, schema)
    return parts.groupBy("part").applyInArrow(total, schema).repartition(1).mapInArrow(ratios, "participation double, mean_cosine double, mean_norm double")
