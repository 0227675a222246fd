"""Readers with fixed schemas and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A written value that no data holds, so that null and the empty string stay apart.
NULL = "\\N"


def csv_strings(spark: SparkSession, path: str, columns: list[str], keep: list[str]) -> DataFrame:
    """All columns as strings, only `keep` parsed."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in columns])
    return spark.read.schema(schema).csv(path, header=True, nullValue=NULL, emptyValue="", escape='"').select(*keep)


def tsv_plain(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated without quoting; further fields of a line are dropped."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in columns])
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def image_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(all other columns, bytes) of shards whose image column is jpg or image; shards with neither
    are left out, as are unreadable files.

    Tasks look at the shards' footers; shards of one schema are read together, so there are as many
    reads as schemas, not as shards.
    """
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import parquet as pq

    from ..operators.quality import image_bytes
    from .files import opened

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = []
            for uri in b.column(0).to_pylist():
                try:
                    store, path = opened(uri)
                    with store.open_input_file(path) as f:
                        kinds.append(str(pq.read_schema(f).remove_metadata()))
                except (OSError, pa.ArrowInvalid):
                    kinds.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], names=["path", "kind"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths).select("path")
    groups = files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(probe, "path string, kind string").where("kind IS NOT NULL").groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    out = None
    for row in groups.orderBy("kind").toLocalIterator():
        df = spark.read.option("ignoreCorruptFiles", "true").parquet(*row["paths"])
        if {"jpg", "image"} & set(df.columns):
            one = df.withColumn("bytes", image_bytes(df)).drop("jpg", "image")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no shard has an image column")
    return out


def hub_dataset(spark: SparkSession, root: str, name: str, split: str, config: str | None = None) -> DataFrame:
    """The rows of a split of an exported data set: Parquet files <root>/<name>[/<config>]/<split>-*.parquet,
    or a folder <split> of them."""
    base = "/".join(x for x in (root.rstrip("/"), name, config) if x)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for pattern in (f"{base}/{split}-*.parquet", f"{base}/{split}/*.parquet", f"{base}/data/{split}-*.parquet"):
        path = hadoop.Path(pattern)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            return spark.read.parquet(pattern)
    raise FileNotFoundError(f"no split {split} of {base}")


def looked_up(asked: DataFrame, cache: DataFrame, key: str, call, answer: str, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """(key, answer, from_cache) of the distinct keys: what the cache holds, else what `call(key)` gives.

    Only keys that the cache lacks are asked for, each task in threads; a call that fails is tried again
    after growing pauses, and one that fails to the end gives null, so that it is asked for again.
    """
    from collections.abc import Iterator

    import pandas as pd

    kind = asked.schema[key].dataType.simpleString()
    keys = asked.select(key).distinct()

    def one(k):
        import time

        for n in range(tries):
            try:
                return call(k)
            except Exception:  # noqa: BLE001  any failure of a service is tried again
                time.sleep(pause * n)
        return None

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(8) as pool:
            for b in batches:
                yield pd.DataFrame({key: b[key], answer: list(pool.map(one, b[key].tolist()))})

    known = keys.join(cache.select(key, answer), key).withColumn("from_cache", F.lit(True))
    missing = keys.join(cache.select(key), key, "left_anti").mapInPandas(fetch, f"{key} {kind}, {answer} string").withColumn("from_cache", F.lit(False))
    return known.unionByName(missing)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated ids of text files."""
    return spark.read.text(path).select(F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("id"))


def frozen_keys(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The keys of a file whose SHA-256 must match."""
    raw = spark.read.format("binaryFile").load(f"{path}/part-*").where("length > 0")
    same = F.when(F.sha2("content", 256) == digest, F.decode("content", "utf-8")).otherwise(F.raise_error(F.lit("the key list has changed")))
    return raw.select(F.explode(F.filter(F.split(same, "\n"), lambda x: x != "")).alias("key"))


def answered(asked: DataFrame, path: str, key: str, call, answer: str, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """looked_up with a cache that is kept: new answers are written to it as a new version before they are
    returned, so each is asked for once; keys without an answer are not written and are asked for again."""
    from ..operators.sinks import load_state, upsert_state, versions
    from ..scratch import written

    spark = asked.sparkSession
    kind = asked.schema[key].dataType.simpleString()
    cache = load_state(spark, path) if versions(spark, path) else spark.createDataFrame([], f"{key} {kind}, {answer} string")
    out = written(looked_up(asked, cache, key, call, answer, tries, pause), "answers")
    fresh = out.where(~F.col("from_cache") & F.col(answer).isNotNull()).select(key, answer)
    if fresh.limit(1).count():
        upsert_state(fresh, path, key)
    return out
