"""Zero-shot evaluation: classes merged by their text, gold labels remapped, unlabelled rows ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import group_mean, nearest_class


def merged_classes(paths: DataFrame, text: str, vec: str) -> DataFrame:
    """(text, v): one class for each text, at the mean of its paths' vectors."""
    return group_mean(paths, [text], vec, "v")


def top1(rows: DataFrame, key: str, vec: str, gold: str, paths: DataFrame, text: str, pvec: str) -> DataFrame:
    """(correct, n_eval, n_classes, n_paths, top1): a row is right where the nearest class has its gold
    text; rows without gold are predicted but not counted."""
    classes = merged_classes(paths, text, pvec)
    guess = nearest_class(rows.where(F.col(gold).isNotNull()), key, vec, classes, text, "v")
    j = rows.where(F.col(gold).isNotNull()).select(key, F.col(gold).alias("_gold")).join(guess, key)
    hits = j.agg(F.count_if(F.col("_gold") == F.col(text)).alias("correct"), F.count("*").alias("n_eval"))
    sizes = paths.agg(F.count_distinct(text).alias("n_classes"), F.count("*").alias("n_paths"))
    return hits.join(F.broadcast(sizes)).withColumn("top1", 100 * F.col("correct") / F.greatest(F.col("n_eval"), F.lit(1)))  # one row


def by_rank(rows: DataFrame, key: str, vec: str, gold: dict[str, str], paths: dict[str, DataFrame], text: str, pvec: str) -> DataFrame:
    """(rank, correct, n_eval, n_classes, n_paths, top1) for each rank, and their average's top1."""
    parts = [top1(rows, key, vec, gold[r], paths[r], text, pvec).select(F.lit(r).alias("rank"), "*") for r in gold]
    each = reduce(DataFrame.unionByName, parts)
    empty = [F.lit(None).cast("long").alias(c) for c in ("correct", "n_eval", "n_classes", "n_paths")]
    return each.unionByName(each.agg(F.avg("top1").alias("top1")).select(F.lit("average").alias("rank"), *empty, "top1"))


def accuracy(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """(label, correct, n_eval, top1, n_classes, macro): by label, with the number of labels and the mean of
    their accuracies."""
    hit = F.count_if(F.col(gold) == F.col(guess))
    each = rows.groupBy(F.col(gold).alias("label")).agg(hit.alias("correct"), F.count("*").alias("n_eval"), (hit * 100 / F.count("*")).alias("top1"))
    every = Window.partitionBy()  # one row for each label
    return each.withColumns({"n_classes": F.count("*").over(every), "macro": F.avg("top1").over(every)})
