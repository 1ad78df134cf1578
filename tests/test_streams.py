"""File intake, stored output and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from tenderspark.operators import maintenance as mt
from tenderspark.operators.maintenance import ingest_counts, to_notice_row
from tenderspark.operators.departments import alias_table
from tenderspark.plans.ingest import flatten_metadata, ingest, process
from tenderspark.sources.raw import read_raw, write_processed
from tenderspark.streaming import buckets
from tenderspark.streaming.intake import archive_committed, intake, read_latest_views, stream_latest_views


def land(folder, name, **fields):
    with open(os.path.join(folder, name), "w") as out:
        json.dump({"source": "SAM.gov", "status": "active", "is_relevant": True, **fields}, out, indent=1)


def test_reader_counts_broken_files(spark, tmp_path):
    land(tmp_path, "samgov_1.json", external_id="1", metadata={"documents": [{"label": "a", "url": "u"}], "extra": 1})
    land(tmp_path, "samgov_2.json", external_id="")
    land(tmp_path, "other_3.json", external_id="3")
    (tmp_path / "samgov_4.json").write_text("not json")
    got = {r.ingest_status: r.n for r in ingest_counts(read_raw(spark, [str(tmp_path)], "samgov_").cache()).collect()}
    assert got == {"failed": 1, "skipped": 1, "upserted": 1}


def test_intake_handles_each_file_once(spark, tmp_path):
    src, out, check, archive = (str(tmp_path / n) for n in ("in", "out", "check", "archive"))
    os.mkdir(src)
    run = lambda: intake(spark, src, archive, out, check, lambda b: b.select("external_id"))
    land(src, "a b.json", external_id="1")
    assert run() == 1 and os.listdir(archive) == ["a b.json"] and os.listdir(src) == []
    land(src, "b.json", external_id="2")
    assert run() == 1 and run() == 0 and sorted(os.listdir(archive)) == ["a b.json", "b.json"]
    ids = sorted(r.external_id for r in spark.read.parquet(out).collect())
    assert ids == ["1", "2"]


def test_files_of_a_batch_that_broke_off_stay(spark, tmp_path):
    src, out, check, archive = (str(tmp_path / n) for n in ("in", "out", "check", "archive"))
    os.mkdir(src)
    land(src, "a.json", external_id="1")

    def broken(batch):
        raise RuntimeError("broken on purpose")

    with pytest.raises(Exception, match="broken on purpose"):
        intake(spark, src, archive, out, check, broken)
    os.makedirs(os.path.join(check, "commits"), exist_ok=True)
    assert archive_committed(spark, check, archive) == 0 and os.listdir(src) == ["a.json"]
    assert intake(spark, src, archive, out, check, lambda b: b.select("external_id")) == 1
    assert [r.external_id for r in spark.read.parquet(out).collect()] == ["1"]


def test_a_change_reads_and_writes_only_its_buckets(spark, tmp_path):
    root, keys = str(tmp_path / "t"), ["id"]
    base = spark.range(200).select(F.col("id"), F.lit("old").alias("v"))
    buckets.create(base, root, keys, 32)
    new = lambda k: spark.createDataFrame([(k, "new")], "id long, v string")
    fold = lambda before, batch: mt.merge_sparse(before, batch, keys)
    touched = buckets.change(new(5), root, 1, keys, fold)
    assert len(touched) == 1
    files = lambda v: {f.removeprefix("file:") for f in buckets.read(spark, root, v).inputFiles()}
    assert len(files(0) - files(1)) == len(files(1) - files(0)) == 1 and all(f"_b={touched[0]}/" in f for f in files(1) - files(0))
    # Files of other buckets are spoilt: a change that read them would fail.
    other = next(k for k in range(200) if k != 5 and buckets.change(new(k), root, 2, keys, fold) != touched)
    for f in files(2):
        if f"_b={touched[0]}/" not in f:
            with open(f, "w") as out:
                out.write("spoilt")
    assert buckets.change(new(5), root, 3, keys, fold) == touched
    assert not os.path.exists(os.path.join(root, "data", "v=0", f"_b={touched[0]}")) and sorted(os.listdir(os.path.join(root, "manifest"))) == ["v=2", "v=3"]
    assert other != 5 and buckets.read(spark, root, 3, touched).filter("id = 5").first().v == "new"


def test_changes_add_remove_and_run_again(spark, tmp_path):
    root, keys = str(tmp_path / "t"), ["id"]
    df = lambda rows: spark.createDataFrame(rows, "id long, v string")
    buckets.create(df([]), root, keys, 4)
    assert buckets.read(spark, root).count() == 0
    add = lambda before, batch: before.unionByName(batch)
    drop = lambda before, batch: before.join(batch, "id", "left_anti")
    for _ in range(2):  # the same change again, as after a lost driver
        buckets.change(df([(k, "a") for k in range(10)]), root, 1, keys, add)
    buckets.change(df([(k, "a") for k in range(10) if k != 3]), root, 2, keys, drop)
    assert buckets.read(spark, root).collect() == [(3, "a")]
    buckets.change(df([(3, "a")]), root, 3, keys, drop)
    assert buckets.read(spark, root).count() == 0
    buckets.change(df([(7, "b")]), root, 4, keys, add)
    assert buckets.read(spark, root).collect() == [(7, "b")]


def test_processed_output_keeps_other_sources(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "zz int, title string, source string, external_id string")
    write_processed(make([(1, "a", "x", "1"), (2, "b", "y", "2")]), path)
    write_processed(make([(3, "c", "y", "3")]), path)
    got = spark.read.parquet(path)
    assert sorted((r.source, r.external_id) for r in got.collect()) == [("x", "1"), ("y", "3")]
    assert got.columns == ["external_id", "title", "zz", "source"]


def test_views_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "v"), str(tmp_path / "o")
    views = spark.range(300).select((F.col("id") % 5).alias("contractor_id"), (F.col("id") % 7).alias("notice_id"), F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("viewed_at"))
    views.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_latest_views(stream, out, str(tmp_path / "c")).awaitTermination()
    want = views.groupBy("contractor_id", "notice_id").agg(F.max("viewed_at").alias("viewed_at"))
    assert sorted(map(tuple, read_latest_views(spark, out).collect())) == sorted(map(tuple, want.select("contractor_id", "notice_id", "viewed_at").collect()))


def test_notice_file_to_table_and_amendment(spark, tmp_path):
    text = "The department is seeking a software system for the city of Fresno, CA. The contractor shall provide cloud hosting for all of its users. It must run."
    land(tmp_path, "n.json", external_id="7", title="Cloud  hosting for records", dept="CDT", description=text, content_hash="h1", due_date="2026-05-01",
         metadata={"event_type": "RFI", "documents": [{"label": "SOW.pdf", "url": "u1"}]})
    raw = flatten_metadata(read_raw(spark, [str(tmp_path)]))
    done = process(raw, alias_table(spark))
    row = done.first()
    assert (row.source, row.dept, row.location, row.location_level) == ("sam.gov", "California Department of Technology", "Fresno", "city")
    assert "Cloud" in row.tags and row.tags[-1] == "Fresno" and row.name == "Cloud hosting for records"
    table, none = ingest(to_notice_row(done.limit(0)), done, "2026-01-01 00:00:00")
    assert table.count() == 1 and none.count() == 0
    changed, log = ingest(table, done.withColumn("content_hash", F.lit("h2")).withColumn("title", F.lit("New title")), "2026-01-02 00:00:00")
    assert changed.select("status", "content_hash", "title").first() == ("amended", "h2", "New title")
    assert set(log.first().changes) == {"title"}
    # A later batch in which nothing changes keeps the time of the amendment.
    later, log = ingest(changed, done.withColumn("content_hash", F.lit("h2")).withColumn("title", F.lit("New title")), "2026-01-03 00:00:00")
    assert log.count() == 0 and str(later.first().last_amended_at) == "2026-01-02 00:00:00"


def test_merge_of_many_rows_has_more_files_and_buckets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(buckets, "PART_ROWS", 50)
    made, create = [], buckets.create
    monkeypatch.setattr(buckets, "create", lambda df, root, keys, n: (made.append(n), create(df, root, keys, n)))
    queries, checks = entry.queries(), entry.oracle_sql()
    ok, note = compare(spark, connect(sf_dir), "streamed_merge", queries["streamed_merge"], checks["streamed_merge"], sf_dir)
    assert ok, note
    assert made == [buckets.parts_for(spark.read.parquet(f"{sf_dir}/orders.parquet").count(), 16)] and made[0] > 16
