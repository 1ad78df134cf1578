"""Row selection per key that stays safe when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], latest: bool = False) -> DataFrame:
    """One row per key: the least (or, with `latest`, greatest) by `order`.

    An aggregate, so each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First `n` rows per key.  `order` must be total.

    The rank filter is pushed below the shuffle, so a hot key sends at most `n`
    rows per task.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              buckets: Sequence[tuple[Column, bool]], name: str = "rank") -> DataFrame:
    """Exact 1-based row number per key without sorting a whole key in one task.

    `buckets` are coarse expressions that grow (or, where the flag is False,
    fall) along `order`; null buckets come last.  Rows are numbered inside
    (key, buckets) and shifted by the rows of earlier buckets.  The shift is
    summed level by level: over the first bucket within a key, over the second
    within key and first, and so on, so no window sees more than one level's
    bucket counts.  With no keys it ranks the whole table.
    """
    cols = [f"_b{i}" for i in range(len(buckets))]
    bucketed = df
    for c, (expr, _) in zip(cols, buckets):
        bucketed = bucketed.withColumn(c, expr)
    group = [*keys, *cols]
    counts = bucketed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.lit(0).cast("bigint"))
    for depth, (c, (_, up)) in enumerate(zip(cols, buckets)):
        outer = [*keys, *cols[:depth]]
        direction = F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last()
        before = Window.partitionBy(*outer).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        level = counts if depth == len(cols) - 1 else counts.groupBy(*outer, c).agg(F.sum("_n").alias("_n"))
        level = level.select(*[F.col(k).alias(f"_l_{k}") for k in (*outer, c)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
        offsets = offsets.join(level, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in (*outer, c)]) \
            .withColumn("_offset", F.col("_offset") + F.col("_shift")).select(*group, "_n", "_offset")
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in group], "_offset")
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    match = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in group]
    return (local.join(offsets, match)
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .select(*df.columns, name))


def last_before(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, out: str, bucket: str = "hour") -> DataFrame:
    """Adds the last non-null `value` of earlier rows of the same key.

    Rows are read inside one time bucket of the key; what earlier buckets left
    is carried over from one row per bucket, so a hot key is spread over tasks.
    """
    work = df.withColumn("_v", value).withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = work.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
    per_bucket = work.filter(F.col("_v").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(ts, tie)).alias("_end"))
    # A bucket without a value still needs what came before it.
    spans = work.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).join(per_bucket, [*keys, "_b"], "left")
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_b", F.last("_end", ignorenulls=True).over(across).alias("_carried"))
    return local.join(carried, [*keys, "_b"]).withColumn(out, F.coalesce("_local", "_carried")).select(*df.columns, out)
