"""Product event counts, funnels and variant comparison (user_id, event_type, ts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.common import literals


def daily_counts(events: DataFrame, types: Sequence[str], last_day: str, days: int = 30) -> DataFrame:
    """(day, event_type, n) for each of the last `days` days and every type, zero included."""
    last = F.lit(last_day).cast("date")
    first = F.date_sub(last, days - 1)
    counted = events.filter(F.col("event_type").isin(*types) & (F.col("ts") >= first.cast("timestamp")) & (F.col("ts") < F.date_add(last, 1).cast("timestamp"))) \
        .groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("_n"))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day")) \
        .select("day", F.explode(literals(types)).alias("event_type"))
    return spine.join(counted, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("_n", F.lit(0)).alias("n"))


def funnel(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(step, event_type, users, rate): users who did the steps in this order; rate is the share of the first step's users.

    Per step the events meet one row per user and fold into the earliest time at or after the step before.
    """
    reached = events.filter(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("ts").alias("t0"))
    for i, step in enumerate(steps[1:], 1):
        done = events.filter(F.col("event_type") == step).select("user_id", "ts") \
            .join(reached.filter(F.col(f"t{i - 1}").isNotNull()).select("user_id", f"t{i - 1}"), "user_id") \
            .filter(F.col("ts") >= F.col(f"t{i - 1}")).groupBy("user_id").agg(F.min("ts").alias(f"t{i}"))
        reached = reached.join(done, "user_id", "left")
    counts = reached.agg(*[F.count(f"t{i}").alias(f"c{i}") for i in range(len(steps))])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("event_type"), F.col(f"c{i}").alias("users"),
                              (F.col(f"c{i}") / F.nullif(F.col("c0"), F.lit(0))).alias("rate")) for i, s in enumerate(steps)])
    return counts.select(F.inline(rows))


def daily_pivot(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row per day, one count column per type."""
    return events.filter(F.col("event_type").isin(*types)).groupBy(F.to_date("ts").alias("day")) \
        .agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in types])


def variant_compare(events: DataFrame, variant: Column) -> DataFrame:
    """(variant, event_type, n, users, share): actions per variant and their share within it."""
    base = events.withColumn("variant", variant).groupBy("variant", "event_type", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    per = base.groupBy("variant", "event_type").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("users"))
    totals = per.groupBy("variant").agg(F.sum("n").alias("_all"))
    return per.join(totals, "variant").select("variant", "event_type", "n", "users", (F.col("n") / F.col("_all")).alias("share"))


def variant_switches(events: DataFrame, source: Column, target: Column) -> DataFrame:
    """(from_variant, to_variant, n) of switch events."""
    return events.groupBy(source.alias("from_variant"), target.alias("to_variant")).agg(F.count(F.lit(1)).alias("n"))
