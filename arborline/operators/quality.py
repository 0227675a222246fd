"""Filters, cleaning and fail-fast checks of row quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"^\s+|\s+$"


def padded_or_empty(x: Column) -> Column:
    """Not null, and empty or with white space at an end (trim would strip blanks only)."""
    return (x == "") | (x != F.regexp_replace(x, WHITE, ""))


def assert_that(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df; its evaluation fails where `ok` does not hold."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[first].dataType)))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct values (null counts as one) and whether the key is unique."""
    k, n = F.col(key), F.count("*")
    distinct = F.count_distinct(k) + (n > F.count(k)).cast("int")
    return df.agg(n.alias("n"), distinct.alias("n_unique"), (distinct == n).alias("is_unique"))


def null_pattern(cols) -> Column:
    """One sign for each column: x, or - where it is null."""
    return F.concat(*[F.when(F.col(x).isNull(), "-").otherwise("x") for x in cols])


def status_ok(col: str) -> Column:
    return F.col(col).isNull() | (F.col(col).cast("string") == "success")


def at_least_or_null(col: str, least: float) -> Column:
    """A threshold that lets unknown values pass."""
    return F.col(col).isNull() | (F.col(col) >= least)


def later_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row whose text a row of a smaller key has: the first of each text by a partial
    aggregate, so that a text that many rows share is no bottleneck."""
    h = df.select(F.col(key), F.sha2(F.col(text), 256).alias("_h"))
    first = h.groupBy("_h").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return h.join(first, "_h").where(F.col(key) > F.col("_first")).select(key)


def without(df: DataFrame, drops: DataFrame, key: str, drop_col: str = "drop_id") -> DataFrame:
    """Anti join with a drop list; ids that are no numbers raise, as does a missing column."""
    if drop_col not in drops.columns:
        raise ValueError(f"the drop list has no column {drop_col}")
    ids = drops.select(F.col(drop_col).cast("bigint").alias(key)).distinct()
    return df.join(ids, key, "left_anti")


def clean_text(x: Column) -> Column:
    """Text or UTF-8 bytes without surrounding white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(x.cast("string"), WHITE, ""), F.lit(""))


def image_bytes(df: DataFrame) -> Column:
    """The bytes of whichever image columns the schema has, jpg before image."""
    found = []
    for name in ("jpg", "image"):
        if name in df.columns:
            kind = df.schema[name].dataType
            found.append(F.col(f"{name}.bytes") if kind.typeName() == "struct" else F.col(name))
    if not found:
        raise ValueError("no image column")
    return F.coalesce(*found)


def equal_if_set(df: DataFrame, col: str | None, value) -> DataFrame:
    """Filter on equality; without a column or a value nothing is filtered."""
    return df if col is None or value is None else df.where(F.col(col) == value)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, keys).where(F.struct(*order) == F.col("_first")).drop("_first")


def options_agree(caption_col: str, drop_table: str | None) -> bool:
    """A drop list of captions only fits the plain caption column."""
    return drop_table is None or caption_col == "caption"


def options_agree_col(caption_col: Column, drop_table: Column) -> Column:
    """The same of columns, for settings of many runs."""
    return drop_table.isNull() | F.coalesce(caption_col == "caption", F.lit(False))


def has_column(df: DataFrame, col: str) -> bool:
    return col in df.columns


def override(df: DataFrame, col: str, rules: list[tuple[Column, object]]) -> DataFrame:
    """Values replaced where a rule holds; the last rule that holds wins."""
    out = F.col(col)
    for when, value in rules:
        out = F.when(when, F.lit(value)).otherwise(out)
    return df.withColumn(col, out)
