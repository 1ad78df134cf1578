"""Staging, Arrow and column helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderspark.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Written tables under ``spark.checkpoint.dir`` that a job reads again.

    They cut lineage and survive a lost executor.  `drop` removes one as soon as
    nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self._count = itertools.count()

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._count)}-{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if f"/{self.root.rpartition('/')[2]}/" in folder:
                    delete(self.spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that no column of the caller can clash with one of an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `text` (null: empty)."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` in batches of `BATCH_BYTES` at most (a single longer row stands alone); a task's memory goes back to the system at its end.

    Whole texts would else fill batches of 64 MB, which the executor and its Python workers all hold.  The
    setting stays in the session, as Spark reads it only when the plan runs.
    """
    conf = df.sparkSession.conf
    conf.set(BATCH, str(BATCH_BYTES))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(work, schema)


def give_back() -> None:
    """Free memory of this worker, which waits for its next task, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_held: tuple = (None, None)


def remembered(key: tuple, make: Callable[[], object]):
    """What `make` gives, kept by a Python worker until it needs something else: stages share workers, which then hold the memory of one only."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        give_back()
        _held = (key, make())
    return _held[1]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` (strings or binaries) holds about `most` bytes at a time; a single longer value stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            yield batch.slice(a, b - a)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by `keys`, one table for each key; only the rows of one key are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            values = c.to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            key = tuple(c[a].as_py() for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
