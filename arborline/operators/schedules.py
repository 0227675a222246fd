"""Schedules and geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_decay(t: Column, horizon: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - t / F.lit(float(horizon)))


def warmup_cosine(t: Column, warmup: int | Column, total: int | Column) -> Column:
    """Linear up to 1 over `warmup` steps, then half a cosine down to 0."""
    w, n = (x if isinstance(x, Column) else F.lit(x) for x in (warmup, total))
    return F.when(t < w, (t + 1) / w.cast("double")).otherwise(0.5 * (1 + F.cos(F.pi() * (t - w) / (n - w))))


def position_angles(pos: Column, size: int) -> Column:
    """The angles of a position of a table of `size` columns: half sines, half cosines of them."""
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), lambda i: pos / F.pow(F.lit(10000.0), i * 2 / size))


def looked_at(t: Column, every: int | None = None, window: tuple[int, int] | None = None) -> Column:
    """Whether a step is one of every so many, or lies in a window (its ends included)."""
    regular = t % every == 0 if every else F.lit(False)
    return regular | t.between(*window) if window else regular


def center_crop(w: Column, h: Column, size: int) -> dict[str, Column]:
    """The resized sides (the shorter is `size`) and the corner of the centre crop, halves to even."""
    rw = F.when(w <= h, F.lit(size)).otherwise(F.floor(F.lit(float(size)) * w / h)).cast("long")
    rh = F.when(h <= w, F.lit(size)).otherwise(F.floor(F.lit(float(size)) * h / w)).cast("long")
    return {"rw": rw, "rh": rh, "x0": F.bround((rw - size) / 2).cast("long"), "y0": F.bround((rh - size) / 2).cast("long")}
