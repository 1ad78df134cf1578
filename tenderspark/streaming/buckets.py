"""A keyed table in hash buckets: a change reads and rewrites only the buckets that hold its keys.

A version of the table is a manifest, which says for each bucket that has rows in
which version it was last written.  A change writes its buckets under its own
version and then the manifest, so a change that is run again gives the same, and
one that breaks off leaves the version before it whole.  The version before is
kept for that; older files go.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderspark.session import delete_path


PART_ROWS = 100_000


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """The version in which each bucket was last written; a row for each bucket at most."""
    return {r["bucket"]: r["written"] for r in spark.read.schema("bucket int, written int").parquet(f"{root}/manifest/v={version}").filter("bucket >= 0").collect()}


def _paths(root: str, manifest: dict[int, int]) -> list[str]:
    return [f"{root}/data/v={v}/_b={b}" for b, v in sorted(manifest.items())]


def parts_for(rows: int, least: int) -> int:
    """Parts of about `PART_ROWS` rows, an easy task each; `least` at least."""
    return max(least, math.ceil(rows / PART_ROWS))


def _write(df: DataFrame, root: str, version: int, keys: Sequence[str], buckets: int, manifest: dict[int, int], touched: Sequence[int]) -> None:
    spark, path = df.sparkSession, f"{root}/data/v={version}"
    df.withColumn("_b", _bucket(keys, buckets)).repartitionById(buckets, "_b").write.mode("overwrite").partitionBy("_b").parquet(path)
    written = {int(f.rpartition("/_b=")[2].split("/")[0]) for f in spark.read.schema(df.schema).parquet(path).inputFiles()}
    now = {b: v for b, v in manifest.items() if b not in touched} | {b: version for b in written}
    # A row of its own, so that a table without rows has a version as well.
    spark.createDataFrame([(-1, version), *now.items()], "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version}")


def create(df: DataFrame, root: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Version 0 of a table.  Choose `buckets` so that one of them is an easy task (`parts_for`)."""
    df.sparkSession.createDataFrame([(df.schema.json(), buckets)], "schema string, buckets int").coalesce(1).write.mode("overwrite").json(f"{root}/table")
    _write(df, root, 0, keys, buckets, {}, range(buckets))


def _table(spark: SparkSession, root: str) -> tuple[StructType, int]:
    import json

    row = spark.read.schema("schema string, buckets int").json(f"{root}/table").first()
    return StructType.fromJson(json.loads(row["schema"])), row["buckets"]


def read(spark: SparkSession, root: str, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """A version of the table (the last one), of the buckets in `only` alone where given."""
    schema, _ = _table(spark, root)
    if version is None:
        version = spark.read.parquet(f"{root}/manifest").agg(F.max("v")).first()[0]
    manifest = _manifest(spark, root, version)
    paths = _paths(root, {b: v for b, v in manifest.items() if only is None or b in only})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(batch: DataFrame, root: str, version: int, keys: Sequence[str], fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Writes `version`: the version before it with ``fold(rows of the touched buckets, batch)`` in place of these buckets, which are returned."""
    spark = batch.sparkSession
    _, buckets = _table(spark, root)
    touched = [r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()]  # `buckets` rows at most
    before = _manifest(spark, root, version - 1)
    _write(fold(read(spark, root, version - 1, touched), batch), root, version, keys, buckets, before, touched)
    if version >= 2:  # what the version before has replaced
        older = _manifest(spark, root, version - 2)
        for path in _paths(root, {b: v for b, v in older.items() if before.get(b) != v}):
            delete_path(spark, path)
        delete_path(spark, f"{root}/manifest/v={version - 2}")
    return touched
