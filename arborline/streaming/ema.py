"""State that evolves with batches: the same update as a batch fold and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vectors import vector_sums


def fold_updates(rows: DataFrame, key: str, step: str, vec: str) -> DataFrame:
    """(key, state): starting at the first step's mean, each step's mean of k rows moves the state
    by k / N, where N is all of the key's rows.

    The state is a sum of the steps' means, each weighed by its own share and what the later steps leave of
    it; the weights are numbers in a window, the vectors are summed where they are.
    """
    counts = rows.groupBy(key, step).agg(F.count("*").alias("_k"))
    of_key = Window.partitionBy(key)
    share = F.when(F.row_number().over(of_key.orderBy(step)) == 1, 1.0).otherwise(F.col("_k") / F.sum("_k").over(of_key))
    later = of_key.orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)
    # A share of one, and the first step, leave nothing of what was before.
    left = F.coalesce(F.exp(F.sum(F.log1p(-F.col("_share"))).over(later)), F.lit(1.0))
    weights = counts.withColumn("_share", share).withColumn("_w", F.col("_share") * left).select(key, step, (F.col("_w") / F.col("_k")).alias("_w"))
    weighed = rows.join(weights, [key, step]).select(key, F.transform(vec, lambda x: x * F.col("_w")).alias("_v"))
    return vector_sums(weighed, [key], "_v").select(key, F.col("s").alias("state"))


def ema_stream(stream: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """A stream of (key, order, value) with the key's exponential average after each row; rows of
    a micro-batch are taken in `order`.  State is one number for each key."""
    kind = dict(stream.dtypes)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        now = state.get[0] if state.exists else None
        out = []
        for v in rows[value]:
            now = float(v) if now is None else now * decay + v * (1 - decay)
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "ema": out})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind[key]}, {order} {kind[order]}, ema double", "ema double", "append", GroupStateTimeout.NoTimeout)


def means_stream(stream: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Running component means by key: an aggregation whose state Spark keeps."""
    return stream.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
