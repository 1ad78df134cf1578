"""Every registered query against its SQL check at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in CHECKS])
def test_query_equals_check(spark, sf_dir, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], CHECKS[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in CHECKS and n != "tagger_predictions"])
def test_unchecked_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["contractor_id", "notice_id", "score", "position"]
