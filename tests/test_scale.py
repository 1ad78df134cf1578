"""Operators that were rewritten for large tables, against the plain way on generated rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenderspark.operators import feed
from tenderspark.operators import retrieval as rt
from tenderspark.operators import scoring as sc
from tenderspark.operators import tagging as tg


def test_candidate_pairs_equal_a_scan_of_the_feed(spark):
    rng = random.Random(11)
    notices = spark.createDataFrame([(i, rng.choice([None, *range(9)])) for i in range(60)], "notice_id bigint, d int") \
        .withColumn("due_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp"))
    order = [r.notice_id for r in notices.orderBy(F.col("due_date").asc_nulls_last(), "notice_id").collect()]
    scored = [(c, rng.randrange(75)) for c in range(6) for _ in range(c * 8)] + [(1, None), (None, 3)]
    scores = spark.createDataFrame(scored, "contractor_id bigint, notice_id bigint")
    people = spark.createDataFrame([(c,) for c in [*range(7), None]], "contractor_id bigint")
    got = feed.candidate_pairs(people, notices, scores, 5).collect()
    want = [(c, n) for c in [*range(7), None] for n in [n for n in order if c is None or (c, n) not in scored][:5]]
    assert sorted(((r.contractor_id, r.notice_id) for r in got), key=str) == sorted(want, key=str)


def test_kept_pairs_join_the_fresh_ones_without_a_shuffle_of_pairs(spark):
    rng = random.Random(5)
    notices = spark.createDataFrame([(n, rng.choice([None, *range(9)])) for n in [*range(40), 3, 7, 7]], "notice_id bigint, d int") \
        .withColumn("due_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp"))
    scores = spark.createDataFrame([(c, rng.randrange(50)) for c in range(6) for _ in range(c * 4)] + [(1, None), (None, 3)], "contractor_id bigint, notice_id bigint")
    people = spark.createDataFrame([(c,) for c in [*range(7), 2, 2, None]], "contractor_id bigint")
    kept = spark.createDataFrame([(c, rng.randrange(60)) for c in range(9) for _ in range(9)], "contractor_id bigint, notice_id bigint").distinct()
    want = feed.candidate_pairs(people, notices, scores, 5).select("contractor_id", "notice_id").union(kept).distinct()
    got = feed.candidate_pairs(people, notices, scores, 5, kept)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")].replace("BroadcastExchange", "")


def test_factors_shuffle_no_pair_by_both_keys(spark, sf_dir):
    t = entry.queries()["experience_factor"](spark, sf_dir)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")].replace("BroadcastExchange", "") and "SortMergeJoin" not in plan[:plan.index("Generate")]
    for name in ("agency_factor", "prereq_factor"):  # the pairs move while they are two keys or a department, by their contractor
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(contractor_id" in plan and not re.search(r"hashpartitioning\(contractor_id#\d+L, (notice_id|department)", plan)


def test_crowded_notices_join_as_others(spark, monkeypatch):
    pairs = spark.createDataFrame([(c, n) for c in range(30) for n in (1, 2, 100 + c)] + [(None, 1), (3, None)], "contractor_id bigint, notice_id bigint")
    people = spark.createDataFrame([(c, f"c{c}") for c in range(28)], "contractor_id bigint, c string")
    notices = spark.createDataFrame([(n, f"n{n}") for n in (1, 100, 101, 3)], "notice_id bigint, n string")
    monkeypatch.setattr(sc, "CROWD", 10)
    for how in ("inner", "left"):
        plain = pairs.join(people, "contractor_id", how).join(notices, "notice_id", how)
        got = sc.join_sides(pairs, people, notices, how).select(*plain.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_parts_of_pairs_are_not_broadcast(spark, sf_dir):
    plan = entry.queries()["factor_weights"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("partition", [None, "p"])
def test_grid_of_many_cells_equals_brute_force(spark, monkeypatch, partition):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8)).round(1)
    x[::50] = x[0]  # equal similarities go to the smaller id
    part = ["hot" if n % 2 else f"p{n % 60}" for n in range(700)]
    rows = spark.createDataFrame([(n, part[n], x[n].tolist()) for n in range(700)] + [(900, None, x[1].tolist()), (901, "hot", None), (902, "hot", [0.0] * 8)], "id bigint, p string, embedding array<double>")
    for name, value in (("CELL_ROWS", 60), ("TILE", (16, 40)), ("HELD", 300)):
        monkeypatch.setattr(rt, name, value)
    some = rows if partition else rows.filter("id < 700")
    got = rt.topk_join(some.withColumnRenamed("id", "query_id"), some.withColumnRenamed("id", "item_id"), 4, 0.3, partition).toPandas().sort_values(["query_id", "rank"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sims = (unit @ unit.T).round(12)
    assert got.query_id.max() < 700
    for n in range(0, 700, 7):
        allowed = [m for m in range(700) if sims[n, m] > 0.3 and (partition is None or part[m] == part[n])]
        mine = got[got.query_id == n]
        want = sorted(allowed, key=lambda m: (-sims[n, m], m))[:4]
        assert np.allclose(mine.sim, sims[n, want]) and len(mine) == len(want)


def test_approximate_search_copies_no_vector_for_each_probe(spark):
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(np.random.default_rng(7).standard_normal((400, 8)))], "item_id bigint, embedding array<double>")
    plan = rt.topk_cells(rows.withColumnRenamed("item_id", "query_id"), rows, 5, 0.2, audited=32)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInPandas" not in plan


def test_keyword_tags_equal_a_search_for_each_needle(spark):
    rng = random.Random(2)
    needles = ["ab", "abc", "abcab", "b.c", "ca", "c", "bca b", "x"]
    rules = tuple((n, f"T{i // 2}") for i, n in enumerate(needles))
    texts = ["".join(rng.choice("abc. AX") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tg.keyword_tags(F.col("t"), rules).alias("tags")).collect()
    for r in got:
        assert r.tags == list(dict.fromkeys(tag for needle, tag in rules if needle in (texts[r.i] or "").lower()))


def test_few_fits_run_at_once_on_large_tables(spark, monkeypatch):
    monkeypatch.setattr(tg, "FEATURE_BITS", 10)
    monkeypatch.setattr(tg, "SMALL", 0)
    monkeypatch.setattr(tg, "TAG_VOCABULARY", ("A", "B", "C", "D", "E", "F"))
    running, most, plain = [], [], tg.LogisticRegression.fit

    def fit(self, data):
        running.append(1)
        most.append(len(running))
        model = plain(self, data)
        running.pop()
        return model

    monkeypatch.setattr(tg.LogisticRegression, "fit", fit)
    rows = spark.createDataFrame([(f"word{i % 6} other", ["ABCDEF"[i % 6]]) for i in range(48)], "t string, l array<string>")
    tagger = tg.Tagger.train(rows, "t", "l", max_iter=2)
    assert len(tagger.models) == 6 and max(most) == tg.SPACE
    assert not spark._jsc.getPersistentRDDs()
