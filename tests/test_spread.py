"""Dear rows of a file with one row group are dealt over all tasks; a run's updates are read once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenderspark.catalog.ingesting import _landed
from tenderspark.catalog.registry import Tables
from tenderspark.functions.derive import city_in_text
from tenderspark.functions.text import clean_description, strip_admin_lead
from tenderspark.operators import maintenance as mt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_description", "addenda_removed", "normalized_records"])
def test_texts_are_dealt_over_all_tasks(spark, sf_dir, name):
    assert "RoundRobinPartitioning(8)" in plan(entry.queries()[name](spark, sf_dir))


def test_landed_notices_are_dealt_over_all_tasks(spark, sf_dir):
    assert _landed(Tables(spark, sf_dir), 1, F.lit(True), title=F.lit("x")).rdd.getNumPartitions() == 8


def test_addenda_run_without_python(spark, sf_dir):
    text = plan(entry.queries()["addenda_removed"](spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text


FIELDS = "k string, title string, content_hash string, status string, last_amended_at timestamp"


def _tables(spark):
    base = spark.createDataFrame([("a", "A", "h1", "active", None), ("b", "B", "h1", "active", None), ("b", "B2", "h2", "active", None), ("b", "B3", "h3", "active", None),
                                  ("c", "C", None, "active", None), ("d", "D", "h1", "closed", None), (None, "N", "h1", "active", None)], FIELDS)
    updates = spark.createDataFrame([("a", None, "h1", None, None), ("b", "New", "h2", "active", None), ("c", "New", "h9", None, None), ("d", None, None, None, None),
                                     ("e", "E", "h5", "active", None)], FIELDS)
    return base, updates


def test_one_join_merges_and_marks(spark):
    base, updates = _tables(spark)
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    want = mt.apply_amendments(mt.merge_sparse(base, updates, ["k"]), mt.amendments(base, updates, ["k"], ["title"]), ["k"], at)
    got = mt.merge_amended(base, updates, ["k"], [], at)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_updates_are_read_once(spark, tmp_path):
    base, updates = _tables(spark)
    updates.write.parquet(str(tmp_path / "updates"))
    merged = mt.merge_amended(base, spark.read.parquet(str(tmp_path / "updates")), ["k"], [], F.current_timestamp())
    assert plan(merged).count("FileScan parquet") == 1


def test_short_cuts_keep_results(spark):
    rows = [(None,), ("",), (" \n ",), ("near Davis, CA",), ("Fresno and Davis",), ("This is a combined synopsis.\n\nAll responses. Build it now.",), ("All responses.",)]
    got = spark.createDataFrame(rows, "t string").select(city_in_text(F.col("t")), strip_admin_lead("t"), clean_description("t")).collect()
    assert [r[0] for r in got] == [None, None, None, "Davis", "Davis", None, None]
    assert [r[1] for r in got] == [None, None, None, "near Davis, CA", "Fresno and Davis", "Build it now.", None]
    assert [r[2] for r in got][:3] == [None] * 3
