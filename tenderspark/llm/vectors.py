"""Vectors from arrays of numbers: which take part, and as binaries of doubles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import batch_of, map_arrow

VECTOR = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())])


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, dim, vec``: vec is null where the vector is null, empty, zero, or holds a null or non-finite component."""
    has_label = label in df.columns
    rows = df.select(F.col(key).cast("long").alias("vec_id"), (F.col(label).cast("string") if has_label else F.lit(None).cast("string")).alias("label"),
                     F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            lists = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in col]
            data = [None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x.tobytes() for x in lists]
            yield batch_of(VECTOR, vec_id=batch.column(0), label=batch.column(1), dim=[0 if x is None else len(x) for x in lists], vec=data)

    return map_arrow(rows, work, "vec_id long, label string, dim int, vec binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two each, which is exact, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
