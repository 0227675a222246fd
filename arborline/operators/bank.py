"""A bank of means: one for each leaf of the hierarchy and for each of its ancestors, every leaf weighing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .vectors import dot, group_mean, norm, roll_up

#: The least squared length of a step, below which it counts as this much.
FLOOR = 1e-12


def nodes(leaf_means: DataFrame, ranks: list[str], vec: str = "mean") -> DataFrame:
    """(depth, key, parent, mean, n_leaves, n_children) of the root (depth -1, key empty), every inner
    node and every leaf; n_children counts the nodes one level down."""
    about = []
    for depth in range(-1, len(ranks)):
        own = ranks[: depth + 1]
        key, up = F.concat_ws("|", *own) if own else F.lit(""), F.concat_ws("|", *own[:-1]) if len(own) > 1 else F.lit("")
        about.append(F.struct(F.lit(depth).alias("depth"), key.alias("key"), up.alias("parent"), F.concat_ws("|", *ranks[: depth + 2]).alias("child")))
    sizes = leaf_means.select(F.explode(F.array(*about)).alias("n")).select("n.*").groupBy("depth", "key").agg(F.first("parent").alias("parent"), F.count("*").alias("n_leaves"), F.count_distinct("child").alias("n_children"))
    children = F.when(F.col("depth") < len(ranks) - 1, F.col("n_children")).otherwise(F.lit(0).cast("long")).alias("n_children")
    return roll_up(leaf_means, ranks, vec).join(sizes, ["depth", "key"]).select("depth", "key", "parent", "mean", "n_leaves", children)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def edges(bank: DataFrame) -> DataFrame:
    """Each node below the first level with its parent and the root: step (from the parent) and pos (the
    parent's place from the root)."""
    root = bank.where("depth = -1").select(F.col("mean").alias("root"))
    parent = bank.where("depth >= 0").select(F.col("depth").alias("up"), F.col("key").alias("parent"), F.col("mean").alias("above"), F.col("n_children").alias("siblings"))
    child = bank.where("depth >= 1").withColumn("up", F.col("depth") - 1)
    j = child.join(parent, ["up", "parent"]).join(F.broadcast(root))  # one row
    return j.select("depth", "key", "n_leaves", "n_children", "siblings", minus(F.col("mean"), F.col("above")).alias("step"), minus(F.col("above"), F.col("root")).alias("pos"))


def monitor(bank: DataFrame, leaf_depth: int) -> DataFrame:
    """(depth, rule, by_edge, by_leaf): the mean squared cosine of steps with their parents' places, over
    edges and over leaves.  Rule parent: the parent has several children; literal: the child has not
    just one either.  Edges without a direction are left out."""
    e = edges(bank)
    e = e.withColumn("cos2", F.try_divide(F.pow(dot(F.col("step"), F.col("pos")), 2), dot(F.col("step"), F.col("step")) * dot(F.col("pos"), F.col("pos")))).where("cos2 IS NOT NULL AND siblings > 1")
    literal = (F.col("depth") == leaf_depth) | (F.col("n_children") != 1)
    ruled = e.select("depth", "cos2", "n_leaves", F.explode(F.when(literal, F.array(F.lit("parent"), F.lit("literal"))).otherwise(F.array(F.lit("parent")))).alias("rule"))
    return ruled.groupBy("depth", "rule").agg(F.avg("cos2").alias("by_edge"), (F.sum(F.col("cos2") * F.col("n_leaves")) / F.sum("n_leaves")).alias("by_leaf"))


def penalty(bank: DataFrame, leaves: DataFrame, ranks: list[str], group: str) -> DataFrame:
    """(group, penalty): for each leaf the sum over its ancestors with several leaves of the squared cosine
    between its step from the ancestor and the ancestor's place; their mean by group (a column)."""
    root = bank.where("depth = -1").select(F.col("mean").alias("root"))
    total = F.lit(0.0)
    j = leaves.select(*ranks, group, F.col("mean").alias("own")).join(F.broadcast(root))  # one row
    for depth in range(len(ranks) - 1):
        up = bank.where(F.col("depth") == depth).select(F.col("key").alias(f"k{depth}"), F.col("mean").alias(f"m{depth}"), F.col("n_leaves").alias(f"n{depth}"))
        j = j.withColumn(f"k{depth}", F.concat_ws("|", *ranks[: depth + 1])).join(up, f"k{depth}")
        step, pos = minus(F.col("own"), F.col(f"m{depth}")), minus(F.col(f"m{depth}"), F.col("root"))
        far = dot(pos, pos)
        total = total + F.when((F.col(f"n{depth}") >= 2) & (far > 0), F.pow(dot(step, pos), 2) / (F.greatest(dot(step, step), F.lit(FLOOR)) * far)).otherwise(0.0)
    return j.select(group, total.alias("t")).groupBy(group).agg(F.avg("t").alias("penalty"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(depth, n, dist_mean, dist_p95, turn_mean, turn_p95): how far the nodes of a bank moved, and one less
    the cosine of their places from their own roots."""
    both = old.where("depth >= 0").select("depth", "key", F.col("mean").alias("a")).join(new.where("depth >= 0").select("depth", "key", F.col("mean").alias("b")), ["depth", "key"])
    roots = old.where("depth = -1").select(F.col("mean").alias("ra")).join(new.where("depth = -1").select(F.col("mean").alias("rb")))  # one row each
    j = both.join(F.broadcast(roots)).select("depth", norm(minus(F.col("a"), F.col("b"))).alias("dist"), minus(F.col("a"), F.col("ra")).alias("ca"), minus(F.col("b"), F.col("rb")).alias("cb"))
    j = j.select("depth", "dist", (1 - F.try_divide(dot(F.col("ca"), F.col("cb")), norm(F.col("ca")) * norm(F.col("cb")))).alias("turn"))
    means = j.groupBy("depth").agg(F.count("*").alias("n"), F.avg("dist").alias("dist_mean"), F.avg("turn").alias("turn_mean"))
    p95 = [exact_quantiles(j, ["depth"], x, {f"{x}_p95": 0.95}) for x in ("dist", "turn")]
    return means.join(p95[0], "depth").join(p95[1], "depth")


def moved(leaf_means: DataFrame, key: str, batch: DataFrame) -> DataFrame:
    """leaf_means after one step: the mean of k rows of a leaf with N rows moves its entry by k / N.

    batch: (key, mu, k, n), one row for each leaf that the step touches."""
    j = leaf_means.join(batch.select(key, "mu", (F.col("k") / F.col("n")).alias("beta")), key, "left")
    return j.withColumn("mean", F.when(F.col("mu").isNotNull(), F.zip_with("mean", "mu", lambda a, b: a + (b - a) * F.col("beta"))).otherwise(F.col("mean"))).drop("mu", "beta")


def zero_sum_gap(bank: DataFrame) -> DataFrame:
    """(gap): the largest component of a sum of the steps below a node, over its number of leaves."""
    parent = bank.select(F.col("depth").alias("up"), F.col("key").alias("parent"), F.col("mean").alias("above"), F.col("n_leaves").alias("n"))
    child = bank.where("depth >= 0").withColumn("up", F.col("depth") - 1)
    steps = child.join(parent, ["up", "parent"]).select("up", "parent", "n", F.transform(minus(F.col("mean"), F.col("above")), lambda x: x * F.col("n_leaves") / F.col("n")).alias("g"))
    total = group_mean(steps, ["up", "parent"], "g").join(steps.groupBy("up", "parent").agg(F.count("*").alias("k")), ["up", "parent"])
    return total.select(F.array_max(F.transform("mean", lambda x: F.abs(x) * F.col("k"))).alias("g")).agg(F.max("g").alias("gap"))
