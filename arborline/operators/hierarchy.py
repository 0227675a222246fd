"""The label hierarchy: keys, dense ids, parents, counts, masks, held-out leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


#: Bits of a place within a range; those above are the range's number.
PLACE_BITS = 33


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted by ranges of the whole order, with _range and _place (from 0) as columns of a written
    table: ranges are drawn anew by each run, so what counts them must not run the sort again."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumns({"_range": F.shiftright(at, PLACE_BITS).cast("int"), "_place": at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}), "ranges")


def dense_ids(keys: DataFrame, ranks: list[str], name: str = "sid", last: list[str] | None = None) -> DataFrame:
    """A dense id from 0 by the tuple of ranks (not by the joined string, whose order differs).

    Rows are sorted in ranges of the whole tuple, then each range is moved by the rows before it: no task
    holds more than a range, however many rows share the first rank.
    """
    placed = in_ranges(keys, [*ranks, *(last or [])])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_place") + F.col("_start")).cast("long")).drop("_range", "_place", "_start")


def places(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """The place from 0 of each row within its keys, by the order: ranges of (keys, order) are counted by
    their keys, so a key may fill many ranges."""
    placed = in_ranges(rows, [*keys, *order])
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a key's ranges
    starts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    starts = starts.select(*keys, "_range", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(starts, [*keys, "_range"]).withColumn(name, (F.col("_place") + F.col("_start")).cast("long")).drop("_range", "_place", "_start")


def prefix_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of a value over all rows before each, by the order: sums within ranges, moved by those of the
    ranges before."""
    placed = in_ranges(rows, order)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.sum(value).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_start")).drop("_range", "_place", "_start", "_own")


def leaf_counts(rows: DataFrame, ranks: list[str], group: int) -> DataFrame:
    """One row a leaf: n_s rows, g_s groups of at most `group` rows."""
    return rows.groupBy(*ranks).agg(F.count("*").alias("n_s")).withColumn("g_s", F.ceil(F.col("n_s") / group).cast("long"))


def level_counts(leaves: DataFrame, ranks: list[str]) -> DataFrame:
    """(depth, key, n_leaves, n_children, n_rows) of every inner node, by one roll-up."""
    out = None
    for depth in range(len(ranks) - 1):
        key = F.concat_ws("|", *ranks[: depth + 1])
        child = F.concat_ws("|", *ranks[: depth + 2])
        one = leaves.groupBy(key.alias("key"), child.alias("child")).agg(F.count("*").alias("l"), F.sum("n_s").alias("r")).groupBy("key").agg(F.lit(depth).alias("depth"), F.sum("l").alias("n_leaves"), F.count("*").alias("n_children"), F.sum("r").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out.select("depth", "key", "n_leaves", "n_children", "n_rows")


def with_mask(leaves: DataFrame, ranks: list[str]) -> DataFrame:
    """leaves with p_mask: for each inner rank whether the ancestor there has two leaves or more."""
    out = leaves
    for depth in range(len(ranks) - 1):
        per = leaves.groupBy(*ranks[: depth + 1]).agg((F.count("*") >= 2).alias(f"_m{depth}"))
        out = out.join(per, ranks[: depth + 1])
    masks = [f"_m{depth}" for depth in range(len(ranks) - 1)]
    return out.withColumn("p_mask", F.array(*masks)).drop(*masks)


def held_out(leaves: DataFrame, key: Column, share: float, seed: int = 0) -> DataFrame:
    """A reproducible sample of round-half-even(share * leaves), in the order of md5(seed-key)."""
    n = leaves.agg(F.bround(F.count("*") * share).cast("int").alias("n")).first()["n"]
    return leaves.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), key)), key).limit(n)
