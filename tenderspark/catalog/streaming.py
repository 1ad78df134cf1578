"""Streams over the whole event table, each checked against its batch twin."""

from pyspark.sql import functions as F

from tenderspark.catalog.landing import _raw_files
from tenderspark.catalog.maintaining import _MERGED, KEYS
from tenderspark.catalog.registry import CHECKS, query
from tenderspark.operators.maintenance import PAIR, saved_list, saved_state
from tenderspark.session import scratch_path
from tenderspark.streaming import buckets, intake, trends


def _stream(t, name):
    """The table's file as a stream source."""
    static = getattr(t, name)
    return t.spark.readStream.schema(static.schema).parquet(f"{t.sf_dir}/{name}*.parquet")


def _run(t, df, name, still_open):
    """A stream to its end: what it has emitted and what its state still holds."""
    out, checkpoint = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-checkpoint")
    trends.write_stream(df, out, checkpoint).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out).unionByName(still_open(t.spark, checkpoint))


@query("streamed_daily_counts", """select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end, event_type, count(*) as n from events group by all""")
def streamed_daily_counts(t):
    return _run(t, trends.stream_counts(_stream(t, "events")), "daily-counts", trends.open_counts)


@query("streamed_sliding_counts", """select w as window_start, w + interval 2 hours as window_end, event_type, count(*) as n from (select time_bucket(interval 1 hour, ts) - interval 1 hour * o as w, event_type from events, (values (0), (1)) v(o)) group by all""")
def streamed_sliding_counts(t):
    return _run(t, trends.stream_counts(_stream(t, "events"), "2 hours", "1 hour"), "sliding-counts", trends.open_counts)


@query("streamed_sessions", """select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from (
 select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as fresh from events))
 group by user_id, sid""")
def streamed_sessions(t):
    return _run(t, trends.stream_sessions(_stream(t, "events")), "sessions", trends.open_sessions)


@query("streamed_latest_views", "select contractor_id, notice_id, max(viewed_at) as viewed_at from {views} group by 1, 2")
def streamed_latest_views(t):
    ids = int(t.orders.count() * 1.25)
    views = _stream(t, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("contractor_id"), (F.col("event_id") * 7 % F.lit(ids)).alias("notice_id"), F.col("ts").alias("viewed_at"))
    out = scratch_path(t.spark, "latest-views")
    intake.stream_latest_views(views, out, scratch_path(t.spark, "latest-views-checkpoint")).awaitTermination()
    return intake.read_latest_views(t.spark, out)


@query("streamed_merge", "select source, external_id, title, name, department, due_date, array_to_string(tags, '|') as tags, status, content_hash from " + _MERGED)
def streamed_merge(t):
    root, updates = scratch_path(t.spark, "merge-table"), scratch_path(t.spark, "merge-updates")
    # Four batches of updates, a key's in one; more rows make more files and buckets, not larger ones.
    rows = t.orders.count()
    files = buckets.parts_for(rows, 4) // 4
    buckets.create(t.old_snapshot, root, KEYS, buckets.parts_for(rows, 16))
    t.new_snapshot.repartition(4 * files, *KEYS).write.parquet(updates)
    stream = t.spark.readStream.schema(t.new_snapshot.schema).option("maxFilesPerTrigger", files).parquet(updates)
    intake.stream_merge(stream, root, scratch_path(t.spark, "merge-checkpoint"), KEYS, ["tags", "deliverables"], ["content_hash"]).awaitTermination()
    return buckets.read(t.spark, root).drop("deliverables", "updated_at").withColumn("tags", F.array_join("tags", "|"))


def _saved_stream(t):
    """The change log landed in four files in the order of time, folded file by file: the table's folder and the rejected changes'."""
    root, landed, rejected = (scratch_path(t.spark, n) for n in ("saved-table", "saved-landed", "saved-rejected"))
    buckets.create(saved_state(t.saved_base), root, PAIR, 16)
    changes = t.saved_changes
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = changes.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - F.lit(first)) * 4 / F.lit(max(1, last - first))), F.lit(3))
    for k in range(4):
        changes.filter(part == k).coalesce(1).write.mode("append").parquet(landed)
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    intake.stream_saved_changes(stream, root, rejected, scratch_path(t.spark, "saved-checkpoint")).awaitTermination()
    return root, rejected


@query("streamed_saved_changes", CHECKS["saved_changes_applied"])
def streamed_saved_changes(t):
    root, _ = _saved_stream(t)
    return saved_list(buckets.read(t.spark, root)).select("contractor_id", "notice_id", "saved_at", "notes", "bid_status", "sort_position")


@query("streamed_saved_rejects", CHECKS["saved_changes_rejected"])
def streamed_saved_rejects(t):
    _, rejected = _saved_stream(t)
    return t.spark.read.parquet(rejected).select("change_id", "contractor_id", "notice_id", "kind")


@query("archived_files", "select count(*) as archived, 0::bigint as left_behind, count(*) filter (where doc_id % 50 <> 7) as taken_in from {portal_text}")
def archived_files(t):
    """Records in the files that intake has archived, in those still in its folder, and taken in: all files of committed batches move."""
    source, out, archive, checkpoint = _raw_files(t, "raw-archived"), *(scratch_path(t.spark, n) for n in ("archived-out", "archive", "archive-checkpoint"))
    intake.intake(t.spark, source, archive, out, checkpoint, lambda b: b.filter("external_id is not null").select("external_id"), multi_line=False, suffix="txt")
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n")).first()[0]
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("taken_in")).select(
        F.lit(counted(t.spark.read.text(archive))).cast("long").alias("archived"), F.lit(counted(t.spark.read.option("pathGlobFilter", "*.txt").text(source))).cast("long").alias("left_behind"), "taken_in")
