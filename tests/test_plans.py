"""Shape of the physical plans."""

import pytest

import __spark_entry__ as entry

NATIVE = ("view_model", "merge_sparse", "amendment_records", "clean_description", "weak_labels", "keyword_factor", "exclusion_gate",
          "agency_factor", "pair_scores", "candidate_pairs", "open_feed_page", "deliverables", "state_portal_records")


def plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_without_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in text


@pytest.mark.parametrize("name", ["chunk_top_k", "project_top_k", "unscored_counts"])
def test_no_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["keep_newest_scores", "history_feed", "candidate_pairs", "chunk_top_k", "document_ranking"])
def test_rank_limit_before_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    text = plan(spark, sf_dir, "filter_usage")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    assert "PushedFilters: [In(event_type" in text


def test_feed_does_not_read_texts(spark, sf_dir):
    assert "html" not in plan(spark, sf_dir, "open_feed_page")
