"""Shard lists, and resampling of shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RANGE = re.compile(r"\{([0-9]+)\.\.([0-9]+)\}")


def expand(pattern: str) -> list[str]:
    """Every numeric range of a pattern, {0000..0015} as sixteen names with zeros to the width of the
    range's start; the first range varies slowest.  What has no range is left to the reader's globs."""
    pieces = RANGE.split(pattern)  # text, start, end, text, ...
    ranges = [[str(n).zfill(len(start)) for n in range(int(start), int(end) + 1)] for start, end in zip(pieces[1::3], pieces[2::3], strict=True)]
    return ["".join(chain.from_iterable(zip(pieces[::3], (*numbers, ""), strict=True))) for numbers in product(*ranges)]


def expand_all(patterns: str | list[str]) -> list[str]:
    """Sorted and distinct expansions of one pattern or several."""
    return sorted({p for one in ([patterns] if isinstance(patterns, str) else patterns) for p in expand(one)})


def hashed_number(seed: int, *cols: str):
    """A whole number from 0 that looks random: the first half of md5(seed-values)."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(x).cast("string") for x in cols])), 1, 8), 16, 10).cast("long")


def resampled(rows: DataFrame, shard: str, shards: int | DataFrame, draws: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of shards drawn with replacement by a hash, with the number of their draw.

    shards: how many there are (numbered from 0), or one row with that number in its first column; draws:
    as many as there are shards if not given.
    """
    spark = rows.sparkSession
    if isinstance(shards, int):
        drawn = spark.range(shards if draws is None else draws).select(F.col("id").alias("draw"), F.lit(shards).cast("long").alias("_of"))
    else:
        of = shards.select(F.col(shards.columns[0]).cast("long").alias("_of"))
        drawn = of.select("_of", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_of") if draws is None else F.lit(draws).cast("long"))).alias("_n")).select((F.col("_n") - 1).alias("draw"), "_of")
    drawn = drawn.withColumn(shard, F.pmod(hashed_number(seed, "draw"), F.col("_of"))).drop("_of")
    return rows.join(drawn, shard)


def buffered_shuffle(rows: DataFrame, buffer: int, seed: int = 0) -> DataFrame:
    """The rows of each partition through a buffer of so many rows: once it is full, each row that comes
    takes the place of one drawn at random, which goes on; what the buffer holds at the end follows in
    random order.

    Every row appears once and at most `buffer` places early; a task holds the buffer and one batch.
    The order follows from the seed, the partition's number and the order of its rows, not from how
    they are cut in batches.
    """
    if buffer < 1:
        raise ValueError("a buffer holds one row at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: pa.Table | None = None
        for b in batches:
            both = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            n = 0 if held is None else held.num_rows
            fill = min(buffer - n, b.num_rows)
            slots, out = list(range(n + fill)), []
            # One number for each row, so that the batches' sizes do not matter.
            for row, u in zip(range(n + fill, both.num_rows), rng.random(both.num_rows - n - fill), strict=True):
                at = int(u * buffer)
                out.append(slots[at])
                slots[at] = row
            if out:
                yield from both.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
            held = both.take(pa.array(slots, pa.int64())).combine_chunks()
        if held is not None and held.num_rows:
            yield from held.take(pa.array(np.argsort(rng.random(held.num_rows), kind="stable"))).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def stream_order(rows: DataFrame, workers: int, draw: str, *within: str) -> DataFrame:
    """Draws dealt to workers by turns, each worker's rows in the order of its draws and of the columns
    within: the streams that a buffered shuffle takes.  A worker is a partition."""
    worker = F.pmod(F.col(draw), F.lit(workers)).cast("int")
    return rows.withColumn("_worker", worker).repartitionById(workers, "_worker").drop("_worker").sortWithinPartitions(draw, *within)


def listed(spark, patterns: list[str]) -> list[str]:
    """The files of several globs on any store, once each, in order; a glob that fits nothing raises."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, set()
    for pattern in expand_all(patterns):
        path = hadoop.Path(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(pattern)
        out |= {str(f.getPath().toString()) for f in found}
    return sorted(out)


@udtf(returnType="shard long, batch long, n long, first long, bytes long")
class ShardBatches:
    """Batches of a shard's rows (shard, id, size) as they come in order; rows without a size are left out.
    State is the open batch's numbers."""

    def __init__(self):
        self.shard, self.most, self.batch, self.n, self.first, self.bytes = None, 1, 0, 0, None, 0

    def _closed(self) -> tuple:
        out = (self.shard, self.batch, self.n, self.first, self.bytes)
        self.batch, self.n, self.first, self.bytes = self.batch + 1, 0, None, 0
        return out

    def eval(self, most: int, row: Row):
        self.shard, self.most = row["shard"], most
        if row["size"] is not None:
            self.first = row["id"] if self.first is None else self.first
            self.n, self.bytes = self.n + 1, self.bytes + row["size"]
            if self.n == most:
                yield self._closed()

    def terminate(self):
        if self.n:
            yield self._closed()


@udtf(returnType="batch long, size long")
class ShardRanges:
    """The batches of a shard of so many rows."""

    def eval(self, rows: int, most: int):
        for k in range(-(-(rows or 0) // most)):
            yield k, min(most, rows - k * most)


def register_batches(spark: SparkSession) -> None:
    """Make the table functions shard_batches and shard_ranges known to SQL."""
    spark.udtf.register("shard_batches", ShardBatches)
    spark.udtf.register("shard_ranges", ShardRanges)
