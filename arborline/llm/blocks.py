"""Quantized vectors in packed blocks, for operators that work by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Rows of a block.
BLOCK_ROWS = 8192
SCHEMA = "dim int, n long, wide boolean, ids array<long>, labels array<long>, data binary"
_TYPES = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_NAMES = ["dim", "n", "wide", "ids", "labels", "data"]


def quantize(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, x as double; what lies beyond 64 bits is held at the ends."""
    x = np.floor(flat.astype(np.float64) * scale)
    with np.errstate(invalid="ignore"):
        whole = x.astype(np.int64)
    whole[x >= 2.0**63] = np.iinfo(np.int64).max
    whole[x < -(2.0**63)] = np.iinfo(np.int64).min
    return whole


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, flat values) of a list column; a length is -1 for lists that are null or hold null
    or non-finite components."""
    start = column.offsets.to_numpy()[: len(column)]
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if column.values.null_count:
        flat[column.values.is_null().to_numpy(zero_copy_only=False)] = np.nan
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    bad = (wrong[start + size] > wrong[start]) | column.is_null().to_numpy(zero_copy_only=False)
    return np.where(bad, -1, size), start, flat


def packed(rows: DataFrame, id_col: str, vec_col: str, scale: int, label_col: str | None = None, dim: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The usable vectors (of `dim` components, if given) in blocks of one length each: ids, labels (0 where
    no column is named) and a row-major matrix of 64-bit integers, 32-bit where `wide` is false.  Vectors
    that are null, empty, or hold null or non-finite components are left out."""

    def block(d: int, ids: list, labels: list, m: list) -> pa.RecordBatch:
        x = np.concatenate(m)
        wide = bool(x.size) and (int(x.max()) >= 2**31 or int(x.min()) < -(2**31))
        values = [d, len(x), wide, pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(labels).to_pylist(), x.astype(np.int64 if wide else np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=_NAMES)

    def run(batches):
        held: dict[int, tuple[list, list, list, int]] = {}
        for b in batches:
            size, start, flat = usable(b.column(2))
            for d in (d for d in np.unique(size).tolist() if d > 0 and dim in (None, d)):
                at = np.flatnonzero(size == d)
                x = quantize(flat[start[at][:, None] + np.arange(d)], scale)
                ids, labels = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                for lo in range(0, len(at), block_rows):
                    i, lab, m, n = held.get(d, ([], [], [], 0))
                    part = x[lo : lo + block_rows]
                    held[d] = ([*i, ids[lo : lo + block_rows]], [*lab, labels[lo : lo + block_rows]], [*m, part], n + len(part))
                    if held[d][3] >= block_rows:
                        yield block(d, *held.pop(d)[:3])
        for d, (ids, labels, m, _) in held.items():
            yield block(d, ids, labels, m)

    label = F.lit(0) if label_col is None else F.col(label_col)
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(tidied(run), SCHEMA)


def matrix(data: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.int64 if wide else np.int32).reshape(n, dim)


def unpacked(b: pa.RecordBatch):
    """(ids, labels, matrix) of each block of a batch; ids and labels are Arrow arrays."""
    for j in range(b.num_rows):
        at = lambda name: b.column(b.schema.get_field_index(name))[j]  # noqa: B023, E731
        yield at("ids").values, at("labels").values, matrix(at("data").as_py(), at("n").as_py(), at("dim").as_py(), at("wide").as_py())
