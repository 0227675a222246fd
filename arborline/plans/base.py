"""Registration of queries, and the catalog views that most of them read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ranks of the four-level hierarchy, from the root.
RANKS = ("r_name", "n_name", "c_mktsegment", "o_orderpriority")
SEVEN = (*RANKS, "c_name", "o_orderstatus", "o_year")
#: Largest group of one leaf in a batch.
GROUP_SIZE = 16


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that DuckDB answers it with."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item: uuid, split and ranks; the last rank is missing in every 11th."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.col("o_orderkey").alias("uuid"),
        F.when(F.col("o_orderkey") % 20 == 0, "val").otherwise("train").alias("split"),
        "r_name", "n_name", "c_mktsegment",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_name", "o_orderstatus", F.year("o_orderdate").cast("string").alias("o_year"), "o_totalprice",
    )


#: The same view for oracles.
CATALOG_SQL = """cat AS (
  SELECT o_orderkey AS uuid, CASE WHEN o_orderkey % 20 = 0 THEN 'val' ELSE 'train' END AS split,
         r_name, n_name, c_mktsegment, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         c_name, o_orderstatus, CAST(year(o_orderdate) AS VARCHAR) AS o_year, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TRAIN_SQL = f"WITH {CATALOG_SQL}, train AS (SELECT *, r_name || '|' || n_name || '|' || c_mktsegment || '|' || o_orderpriority AS key FROM cat WHERE split = 'train' AND o_orderpriority IS NOT NULL)"


def prefix_key(cols, sep: str = "|") -> Column:
    """The ranks joined; null if any is (concat, not concat_ws, which would skip it)."""
    parts = [F.col(x) if isinstance(x, str) else x for x in cols]
    return F.concat(*[y for x in parts for y in (F.lit(sep), x)][1:])


def complete(cols=RANKS) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cols])


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete training rows with their leaf key."""
    return catalog(spark, sf_dir).where((F.col("split") == "train") & complete()).withColumn("key", prefix_key(RANKS))


def hashed(*cols) -> Column:
    """A reproducible order that looks random: md5 of the parts."""
    return F.md5(F.concat_ws("-", *[F.col(x).cast("string") if isinstance(x, str) else x for x in cols]))
