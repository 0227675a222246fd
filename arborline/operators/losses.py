"""Losses of batches of paired vectors, and weights of levels.

A batch is what a training step holds at once, so its logits fit a task; batches are independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix_of


def log_softmax(z: np.ndarray, axis: int = 1) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return z - top - np.log(np.exp(z - top).sum(axis=axis, keepdims=True))


def contrastive(z: np.ndarray) -> float:
    """Cross-entropy of each row's and of each column's own pair, halved."""
    return float(-(np.diag(log_softmax(z, 1)).mean() + np.diag(log_softmax(z, 0)).mean()) / 2)


def sigmoid(z: np.ndarray, bias: float) -> float:
    """Every pair is a yes or no question; the sum of its losses over the rows."""
    y = 2 * np.eye(len(z)) - 1
    return float(np.logaddexp(0, -y * (z + bias)).sum() / len(z))


def distillation(z: np.ndarray, teacher: np.ndarray) -> float:
    """Cross-entropy of a teacher's distributions with the student's, over rows and columns, halved."""
    one = lambda t, s: float(-(np.exp(log_softmax(t)) * log_softmax(s)).sum(axis=1).mean())
    return (one(teacher, z) + one(teacher.T, z.T)) / 2


def batch_losses(rows: DataFrame, batch: str, order: str, image: str, text: str, teacher_image: str, teacher_text: str, scale: float, bias: float) -> DataFrame:
    """(batch, contrastive, sigmoid, distillation, n) of each batch's pairs of vectors."""
    kind = rows.schema[batch].dataType.simpleString()
    cols = [image, text, teacher_image, teacher_text]

    def loss(key, table):
        x, y, u, v = (matrix_of(table[c].combine_chunks()) for c in cols)
        z, t = scale * x @ y.T, scale * u @ v.T
        return pa.table({batch: [key[0].as_py()], "contrastive": [contrastive(z)], "sigmoid": [sigmoid(z, bias)], "distillation": [distillation(z, t)], "n": pa.array([len(x)], pa.int64())})

    src = rows.select(batch, order, *[F.col(c).cast("array<double>").alias(c) for c in dict.fromkeys(cols)])
    return src.groupBy(batch).applyInArrow(loss, f"{batch} {kind}, contrastive double, sigmoid double, distillation double, n long")


def caption_loss(rows: DataFrame, batch: str, logits: str, label: str, pad: int) -> DataFrame:
    """(batch, loss, n): mean cross-entropy of the labels, those that are padding left out."""
    z, y = F.col(logits), F.col(label)
    top = F.array_max(z)
    lse = top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return rows.where(y != pad).groupBy(batch).agg(F.avg(lse - F.element_at(z, (y + 1).cast("int"))).alias("loss"), F.count("*").alias("n"))


def level_weights(levels: DataFrame, loss: str, scheme: str, tau: float = 1.0, ref: str | None = None, grad_norm: str | None = None) -> DataFrame:
    """levels with a weight of mean one.  lse: by the softmax of the losses; ratio: by each loss over its
    reference (all one without any); gradnorm: by one over the gradient's norm.  Levels are few."""
    every = Window.partitionBy()
    if scheme == "lse":
        e = F.exp((F.col(loss) - F.max(loss).over(every)) / tau)
        return levels.withColumn("_e", e).withColumn("weight", F.col("_e") / F.avg("_e").over(every)).drop("_e")
    if scheme == "ratio":
        r = F.col(loss) / F.col(ref) if ref else F.lit(1.0)
        return levels.withColumn("_r", r).withColumn("weight", F.col("_r") / F.avg("_r").over(every)).drop("_r")
    if scheme == "gradnorm":
        return levels.withColumn("_i", 1 / F.greatest(F.col(grad_norm), F.lit(1e-12))).withColumn("weight", F.col("_i") / F.avg("_i").over(every)).drop("_i")
    raise ValueError(f"no weighting is called {scheme}")
