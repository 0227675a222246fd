"""Helpers of the corpus operators: shared intermediate tables that survive lost executors."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import new_path, remove, shared_dir

#: The intermediate tables of the operators that this thread is putting together, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Within it, materialize() notes its tables; finished() deletes them.  After an error all go; what is
    still there at its end is noted in the scope around it, of an operator that called this one."""
    paths: list[str] = []
    around = _scopes.get()
    _scopes.set((*around, paths))
    try:
        yield paths
    except BaseException:
        remove(spark, *paths)
        raise
    finally:
        _scopes.set(around)
    if around:
        around[-1].extend(paths)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def finished(df: DataFrame, tag: str, scope: list[str]) -> DataFrame:
    """df as a table of its own, which no longer needs the intermediate tables of scope: they are
    deleted.  Meant for narrow results; the table itself stays in the shared folder."""
    out, path = materialize(df, tag)
    gone = [p for p in scope if p != path]
    remove(df.sparkSession, *gone)
    scope[:] = [path]
    return out


def tidy() -> None:
    """Give freed memory back to the machine: a Python worker lives on in other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(f: Callable) -> Callable:
    """f, a function over batches (a generator) or over groups, tidying up when it is done."""
    if inspect.isgeneratorfunction(f):

        def over_batches(batches):
            try:
                yield from f(batches)
            finally:
                tidy()

        return over_batches

    def after(*args):
        try:
            return f(*args)
        finally:
            tidy()

    # Spark looks at the number of arguments.
    return {1: lambda a: after(a), 2: lambda a, b: after(a, b), 3: lambda a, b, c: after(a, b, c)}[len(inspect.signature(f).parameters)]


__all__ = ["finished", "materialize", "new_path", "remove", "scratch_scope", "shared_dir", "tidied", "tidy"]
