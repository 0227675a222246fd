"""Metric logs: steps, gaps between runs, exponential smoothing, calibration windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def steps(log: DataFrame, run: str = "user_id", order: str = "ts") -> DataFrame:
    """log with the step of each entry in its run, from 1."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy(run).orderBy(order)))


def gaps(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """For each metric the largest gap between two runs, whether all are equal, and the shared steps."""
    j = a.join(b.withColumnRenamed(value, "_other"), keys)
    metric = [k for k in keys if k != "step"]
    diff = F.abs(F.col(value) - F.col("_other"))
    return j.groupBy(*metric).agg(F.max(diff).alias("max_gap"), F.bool_and(F.col(value) == F.col("_other")).alias("identical"), F.count("*").alias("n"))


def ema(values: Column, decay: float) -> Column:
    """Exponential moving average of an array in order; it starts at the first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1).cast("double"), lambda s, x: s * decay + x * (1 - decay))


def smoothed(log: DataFrame, keys: list[str], order: str, value: str, decay: float, reset: Column | None = None) -> DataFrame:
    """log with `ema`, started anew after each row where `reset` holds.

    The rows of a key are sorted in one partition and go by in batches with one number carried on, so
    a run of any length takes linear time and bounded memory.  A null value leaves the average as it
    is; before the first value it is null.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cut = F.coalesce(F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if reset is not None else F.lit(0)
    runs = log.withColumn("segment", cut.cast("long")).select(*keys, "segment", order, F.col(value).cast("double").alias(value))
    schema = T.StructType([*runs.schema.fields, T.StructField("ema", T.DoubleType())])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, k = None, None, len(keys) + 1
        for b in batches:
            out = []
            for *head, x in zip(*(b.column(i).to_pylist() for i in range(k)), b.column(k + 1).to_pylist(), strict=True):
                if head != at:
                    at, now = head, None
                if x is not None:
                    now = x if now is None else now * decay + x * (1 - decay)
                out.append(now)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=schema.names)

    return runs.repartition(*keys).sortWithinPartitions(*keys, "segment", order).mapInArrow(carry, schema)


def calibrated(log: DataFrame, lo: int, hi: int, by: str = "run") -> DataFrame:
    """The mean over steps lo..hi of the runs that have all of them."""
    span = log.where(F.col("step").between(lo, hi))
    return span.groupBy(by).agg(F.avg("value").alias("mean"), F.count_distinct("step").alias("n")).where(F.col("n") == hi - lo + 1).select(by, "mean")


def gate_status(asked: str, parts: str, errors: str, limited: str, digest: str, wanted: str, every: tuple[str, ...]) -> Column:
    """FAIL where a part that was asked for has failed or has no result, an error stands, or the label files
    differ; PARTIAL where rows were limited or not every part was asked for; else PASS."""
    result = lambda p: F.coalesce(F.try_element_at(F.col(parts), p), F.lit(False))
    failed = F.exists(asked, lambda p: ~result(p)) | (F.col(errors) > 0) | (F.col(digest) != wanted)
    some = F.col(limited) | ~F.forall(F.array(*[F.lit(p) for p in every]), lambda p: F.array_contains(asked, p))
    return F.when(failed, "FAIL").when(some, "PARTIAL").otherwise("PASS")
