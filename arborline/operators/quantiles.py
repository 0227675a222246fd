"""Exact quantiles of groups of any size, in bounded state.

Ranks are narrowed by passes: a sketch of fixed size splits each group's values that are still in
question at regular ranks, exact counts below and within the bracket around the wanted ranks follow,
and what lies outside is left behind.  When a bracket has few different values, these and their
counts decide.  Every pass aggregates on the map side; no task holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Splits of a pass, the sketch's accuracy, and different values that one task may get for a group.
SPLITS, ACCURACY, MOST_VALUES = 128, 8192, 100_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], most: int = MOST_VALUES, splits: int = SPLITS) -> DataFrame:
    """(keys, a column for each share): quantiles with linear interpolation between the two ranks next to
    (n - 1) * share, as the built-in exact percentile gives them.

    Nulls are left out, NaN is above all numbers; a group without values has nulls.  Keys may be null.
    """
    base = rows.select(*keys, F.col(value).cast("double").alias("_x"))
    names = list(shares)
    groups = base.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # For each share: the first and last rank wanted (from 0), the bracket of values that holds them, ranks
    # below the bracket, and whether it is narrow enough.
    at = {n: (F.col("_n") - 1) * F.lit(float(s)) for n, s in shares.items()}
    bracket = lambda n: F.struct(F.floor(at[n]).alias("first"), F.ceil(at[n]).alias("last"), (at[n] - F.floor(at[n])).alias("between"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("below"), (F.col("_n") <= most).alias("done"))
    state = written(groups.select(*keys, "_n", *[bracket(n).alias(n) for n in names]), "quantile-groups")
    inside = lambda n: F.col("_x").between(F.col(f"{n}.lo"), F.col(f"{n}.hi"))
    open_ = F.exists(F.array(*[F.col(f"{n}.done") for n in names]), lambda d: ~d)
    while state.where(open_).limit(1).count():
        held = _with_state(base.where("_x IS NOT NULL"), state, keys)
        seen = held.groupBy(*keys).agg(
            *[F.count_if(F.col("_x") < F.col(f"{n}.lo")).alias(f"_b_{n}") for n in names],
            *[F.approx_count_distinct(F.when(inside(n), F.col("_x"))).alias(f"_d_{n}") for n in names],
            *[F.percentile_approx(F.when(inside(n) & ~F.col(f"{n}.done"), F.col("_x")), [k / splits for k in range(splits + 1)], ACCURACY).alias(f"_s_{n}") for n in names],
            *[F.count_if(inside(n)).alias(f"_c_{n}") for n in names],
        )
        after = state.join(seen, _same(state, seen, keys), "left").select(*[state[k] for k in keys], "_n", *[_narrowed(n, most, splits).alias(n) for n in names])
        state = written(after, "quantile-groups")
    held = _with_state(base.where("_x IS NOT NULL"), state, keys)
    tagged = held.select(*keys, "_x", F.explode(F.array(*[F.struct(F.lit(n).alias("share"), F.col(n).alias("b"), inside(n).alias("in")) for n in names])).alias("s"))
    own = [*keys, "_share"]
    # Counts below the last bracket, and each different value within it.
    cells = tagged.where(F.col("_x") <= F.col("s.b.hi")).groupBy(*keys, F.col("s.share").alias("_share"), F.when(F.col("s.in"), F.col("_x")).alias("_x")).agg(F.count("*").alias("_k"), F.first("s.b").alias("b"))
    upto = F.sum("_k").over(Window.partitionBy(*own).orderBy(F.asc_nulls_first("_x")))  # about `most` different values
    ranked = cells.withColumn("_upto", upto).where("_x IS NOT NULL")
    pick = lambda rank: F.min(F.when(F.col("_upto") > F.col(f"b.{rank}"), F.col("_x")))
    found = ranked.groupBy(*own).agg(pick("first").alias("_a"), pick("last").alias("_z"), F.first("b.between").alias("_t"))
    # Equal ends first, as infinite ones have no difference.
    found = found.withColumn("_q", F.when((F.col("_a") == F.col("_z")) | (F.col("_t") == 0), F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_t")) + F.col("_z") * F.col("_t")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_share") == n, F.col("_q"))).alias(n) for n in names])
    all_groups = groups.select(*keys)
    return all_groups.join(wide, _same(all_groups, wide, keys), "left").select(*[all_groups[k] for k in keys], *names)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's brackets; without keys there is one row of them."""
    if not keys:
        return rows.join(F.broadcast(state))
    return rows.join(state, _same(rows, state, keys)).select(*[rows[k] for k in keys], "_x", *[c for c in state.columns if c not in keys])


def _narrowed(n: str, most: int, splits: int) -> Column:
    """The bracket after a pass: around the wanted ranks, by the sketch; ranks below are what was counted.

    A bracket that turns out not to hold the ranks (which the sketch's error bound excludes) is given up
    for the whole range: the result stays exact."""
    b, below, within = F.col(n), F.coalesce(F.col(f"_b_{n}"), F.lit(0).cast("long")), F.coalesce(F.col(f"_c_{n}"), F.lit(0).cast("long"))
    few = F.coalesce(F.col(f"_d_{n}") <= most, F.lit(True)) | (b["lo"] == b["hi"])
    lost = ~b["done"] & ((below > b["first"]) | (below + within <= b["last"]))
    place = lambda rank, by: F.floor((rank - below) * splits / F.greatest(within, F.lit(1))).cast("int") + by
    cut = lambda i: F.get(F.col(f"_s_{n}"), F.greatest(F.least(i, F.lit(splits)), F.lit(0)))
    # The sketch's ends are approximate too.
    lo = F.when(place(b["first"], -1) <= 0, b["lo"]).otherwise(cut(place(b["first"], -1)))
    hi = F.when(place(b["last"], 2) >= splits, b["hi"]).otherwise(cut(place(b["last"], 2)))
    done = b["done"] | few
    whole = F.struct(b["first"].alias("first"), b["last"].alias("last"), b["between"].alias("between"), F.lit(float("-inf")).alias("lo"), F.lit(float("nan")).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("done"))
    next_ = F.struct(b["first"].alias("first"), b["last"].alias("last"), b["between"].alias("between"), F.when(done, b["lo"]).otherwise(lo).alias("lo"), F.when(done, b["hi"]).otherwise(hi).alias("hi"), below.alias("below"), done.alias("done"))
    return F.when(lost, whole).otherwise(next_)
