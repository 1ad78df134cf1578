"""Incremental intake and table upkeep as streams.

Every sink writes a folder named after the micro-batch and replaces it when the
batch is run again, so a retried batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderspark.operators.maintenance import PAIR, fold_saved_changes, merge_sparse
from tenderspark.sources.raw import parse_notices
from tenderspark.streaming import buckets


def raw_stream(spark: SparkSession, in_dir: str, prefix: str | None = None, multi_line: bool = True, suffix: str = "json") -> DataFrame:
    """New JSON notices of a folder."""
    reader = spark.readStream.option("pathGlobFilter", f"{prefix or ''}*.{suffix}")
    return parse_notices(reader.text(in_dir, wholetext=multi_line).select("value", F.col("_metadata.file_name").alias("file_name")))


def stream_intake(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, process: Callable[[DataFrame], DataFrame],
                  prefix: str | None = None, multi_line: bool = True, suffix: str = "json") -> StreamingQuery:
    """Run `process` over the files not seen yet and write its rows; ends when there are none.

    The checkpoint keeps each file to one batch; whether a file still lies in `in_dir` says nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return raw_stream(spark, in_dir, prefix, multi_line, suffix).writeStream.foreachBatch(write) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, batch): the files of all batches that the stream's commit log lists as done."""
    listed = spark.read.text(f"{checkpoint}/sources/0").filter("value like '{%'").select(F.from_json("value", "path string, batchId long").alias("f"))
    done = spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("batch")).distinct()
    return listed.select("f.path", F.col("f.batchId").alias("batch")).distinct().join(done, "batch").select("path", "batch")


def archive_committed(spark: SparkSession, checkpoint: str, archive_dir: str) -> int:
    """Moves every file of a committed batch to `archive_dir`, at once rather than with the next batch; returns how many.

    A file whose batch broke off stays and is read again.  The driver holds the
    paths of one partition at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(archive_dir)
    target.getFileSystem(conf).mkdirs(target)
    moved = 0
    for row in committed_files(spark, checkpoint).toLocalIterator():
        source = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["path"]))
        files = source.getFileSystem(conf)
        if files.exists(source):  # else an earlier run moved it
            moved += bool(files.rename(source, jvm.org.apache.hadoop.fs.Path(target, source.getName())))
    return moved


def intake(spark: SparkSession, in_dir: str, archive_dir: str, out_dir: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], **files) -> int:
    """`stream_intake` to its end, then its files are archived; returns how many."""
    stream_intake(spark, in_dir, out_dir, checkpoint, process, **files).awaitTermination()
    return archive_committed(spark, checkpoint, archive_dir)


def stream_changes(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], fold: Callable[[DataFrame, DataFrame, int], DataFrame]) -> StreamingQuery:
    """Every micro-batch folded into the bucketed table `root` (made by `buckets.create`); batch n writes version n + 1."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        buckets.change(batch, root, batch_id + 1, keys, lambda before, new: fold(before, new, batch_id))
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_merge(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], overwrite: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Sparse upsert of every micro-batch."""
    return stream_changes(stream, root, checkpoint, keys, lambda before, new, _: merge_sparse(before, new, keys, overwrite, [F.col(c) for c in order]))


def stream_saved_changes(stream: DataFrame, root: str, rejected_dir: str, checkpoint: str) -> StreamingQuery:
    """A change log of saved lists folded batch by batch into their state; batches come in the order of time.

    `root` is made from `maintenance.saved_state`; `maintenance.saved_list` gives
    the list of a state.  Rejected changes go to a folder for each batch.
    """
    def fold(before: DataFrame, new: DataFrame, batch_id: int) -> DataFrame:
        state, rejected = fold_saved_changes(before, new)
        rejected.write.mode("overwrite").parquet(f"{rejected_dir}/batch={batch_id}")
        return state

    return stream_changes(stream, root, checkpoint, PAIR, fold)


def stream_latest_views(stream: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Newest view per (contractor, notice) of each micro-batch; `read_latest_views` folds the batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("contractor_id", "notice_id").agg(F.max("viewed_at").alias("viewed_at"))
        newest.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest_views(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir).groupBy("contractor_id", "notice_id").agg(F.max("viewed_at").alias("viewed_at"))
