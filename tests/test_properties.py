"""Invariants and brute-force comparisons on generated rows."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderspark.fixed import DEPARTMENT_ALIASES
from tenderspark.functions import derive as dv
from tenderspark.operators import departments as dep
from tenderspark.operators import maintenance as mt
from tenderspark.operators import ranking as rk
from tenderspark.operators import retrieval as rt
from tenderspark.operators import tagging as tg


def texts(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["w" * rng.randint(1, 12) for _ in range(rng.randint(0, 1500))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", ". "]) for w in words))
    return out


def test_chunks_cover_and_stay_small(spark):
    rows = list(enumerate(texts(40) + ["", "short", ",".join(map(str, range(1500)))]))
    df = spark.createDataFrame(rows, "notice_id int, body string")
    got = rt.chunk(df).toPandas()
    assert got["chunk_text"].str.len().max() <= 1200
    for ident, body in rows:
        pieces = got[got.notice_id == ident].sort_values("chunk_index")
        assert list(pieces.chunk_index) == list(range(len(pieces)))
        body, at = body.strip(), 0
        starts = []
        for piece in pieces.chunk_text:
            found = body.index(piece, starts[-1] + 1 if starts else 0)
            assert body[at:found].strip() == "" or found <= at
            starts.append(found)
            at = max(at, found + len(piece))
        assert body[at:].strip() == ""
        assert starts == sorted(set(starts))


def test_rank_rows_equals_row_number_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.choice([None, *range(20)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a int, i int")
    order = [F.col("a").asc_nulls_last(), F.col("i")]
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = rk.rank_rows(df, ["k"], order, [(F.col("a"), True), (F.floor(F.col("i") / 100), True)], "r")
    assert got.join(want, "i").filter("r <> w").count() == 0 and got.count() == 3000
    down = [F.col("a").desc_nulls_last(), F.col("i")]
    want = df.withColumn("w", F.row_number().over(Window.orderBy(*down)))
    got = rk.rank_rows(df, [], down, [(F.col("a"), False)], "r")
    assert got.join(want, "i").filter("r <> w").count() == 0


def test_last_before_equals_window(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), i, rng.randint(0, 5000), rng.choice([None, "a", "b"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, i int, s int, v string").withColumn("ts", F.timestamp_seconds("s"))
    w = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("i", F.last("v", ignorenulls=True).over(w).alias("w"))
    got = rk.last_before(df, ["k"], "ts", "i", F.col("v"), "g")
    assert got.count() == 1500
    assert got.join(want, "i").filter(~F.col("g").eqNullSafe(F.col("w"))).count() == 0


def test_first_by_ignores_input_order(spark):
    rows = [(i % 7, (i * 37) % 101, i) for i in range(500)]
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    got = [sorted(map(tuple, rk.first_by(spark.createDataFrame(r, "k int, a int, i int").repartition(5), ["k"], [F.col("a"), F.col("i")]).collect()))
           for r in (rows, shuffled)]
    assert got[0] == got[1]


def test_merge_is_idempotent_and_keeps_old_values(spark):
    base = spark.createDataFrame([("s", "1", "a", ["x"], "h1"), ("s", "2", "b", ["y"], "h2")], "source string, external_id string, title string, tags array<string>, content_hash string")
    new = spark.createDataFrame([("s", "2", None, None, "h3"), ("s", "3", "c", None, "h4"), (None, "4", "d", None, "h"), ("s", "", "e", None, "h")], base.schema)
    keys = ["source", "external_id"]
    once = mt.merge_sparse(base, new, keys, ["tags"])
    twice = mt.merge_sparse(once, new, keys, ["tags"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {(r.external_id, r.title, tuple(r.tags or ())) for r in once.collect()} == {("1", "a", ("x",)), ("2", "b", ()), ("3", "c", ())}
    replaced = mt.merge_sparse(base, new, keys, ["tags"], replace=["title"])
    assert {(r.external_id, r.title) for r in replaced.collect()} == {("1", "a"), ("2", None), ("3", "c")}


def test_keep_newest_bound(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("c"), F.col("id").alias("i"), (F.col("id") * 7 % 1000).alias("t"))
    kept = mt.keep_newest(df, "c", "t", "i", 100)
    assert kept.groupBy("c").count().agg(F.max("count")).first()[0] == 100


def test_saved_log_against_replay(spark):
    rng = random.Random(9)
    start = {(c, n): dict(saved_at=0, sort_position=c, notes="n", bid_status="pursuing") for c in range(4) for n in range(3)}
    log = [(i, rng.randint(0, 4), rng.randint(0, 5), rng.choice(["save", "unsave", "note", "status"]), i) for i in range(400)]
    value = lambda kind, i: {"note": f" v{i} " if i % 3 else " ", "status": ("submitted", "no_bid", "odd")[i % 3]}.get(kind)
    log = [(i, c, n, kind, value(kind, i), t) for i, c, n, kind, t in log]
    state, rejected = {k: dict(v) for k, v in start.items()}, set()
    for i, c, n, kind, v, t in log:
        key = (c, n)
        if kind == "save":
            state.setdefault(key, dict(saved_at=t + 1, sort_position=None, notes=None, bid_status="reviewing"))
        elif kind == "unsave":
            state.pop(key, None)
        elif key not in state or (kind == "status" and v == "odd"):
            rejected.add(i)
        elif kind == "note":
            state[key]["notes"] = v.strip() or None
        else:
            state[key]["bid_status"] = v
    base = spark.createDataFrame([(c, n, 0, v["sort_position"], v["notes"], v["bid_status"]) for (c, n), v in start.items()],
                                 "contractor_id int, notice_id int, s int, sort_position int, notes string, bid_status string") \
        .select("contractor_id", "notice_id", F.timestamp_seconds("s").alias("saved_at"), "sort_position", "notes", "bid_status")
    changes = spark.createDataFrame(log, "change_id int, contractor_id int, notice_id int, kind string, value string, t int") \
        .select("change_id", "contractor_id", "notice_id", "kind", "value", F.timestamp_seconds(F.col("t") + 1).alias("ts"))
    out, bad = mt.apply_saved_changes(base, changes)
    got = {(r.contractor_id, r.notice_id): (r.notes, r.bid_status) for r in out.collect()}
    assert got == {k: (v["notes"], v["bid_status"]) for k, v in state.items()}
    assert {r.change_id for r in bad.collect()} == rejected
    places = out.toPandas()
    assert not places[places.saved_at > pd.Timestamp(0)].duplicated(["contractor_id", "sort_position"]).any()


def vectors(n, dim=16, seed=0):
    return np.random.default_rng(seed).standard_normal((n, dim))


def test_topk_equals_brute_force_on_a_hot_partition(spark):
    q, x = vectors(40, seed=1), vectors(900, seed=2)
    part = ["hot" if i % 3 else str(i % 5) for i in range(900)]
    qpart = ["hot" if i % 2 else str(i % 5) for i in range(40)]
    items = spark.createDataFrame([(i, part[i], x[i].tolist()) for i in range(900)] + [(9999, "hot", None)], "item_id bigint, p string, embedding array<double>")
    queries = spark.createDataFrame([(i, qpart[i], q[i].tolist()) for i in range(40)], "query_id bigint, p string, embedding array<double>")
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for partition in (None, "p"):
        got = rt.topk_join(queries, items, 5, 0.2, partition, query_splits=3).toPandas().sort_values(["query_id", "rank"])
        for i in range(40):
            allowed = [j for j in range(900) if sims[i, j] > 0.2 and (partition is None or part[j] == qpart[i])]
            want = sorted(allowed, key=lambda j: (-sims[i, j], j))[:5]
            assert got[got.query_id == i].item_id.tolist() == want


@pytest.mark.parametrize("k,threshold,noise", [(1, 0.7, 0.25), (10, 0.2, 1.0)])
def test_recall_of_cells(spark, k, threshold, noise):
    base = vectors(600, seed=5)
    near = base + noise * vectors(600, seed=6)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(1000, None), (1001, [0.0] * base.shape[1])], "item_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "query_id bigint, embedding array<double>")
    exact = {(r.query_id, r.item_id): r.sim for r in rt.topk_join(queries, items, k, threshold).collect()}
    fast = {(r.query_id, r.item_id): r.sim for r in rt.topk_cells(queries, items, k, threshold, audited=64).collect()}
    assert len(fast.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(fast[p] - exact[p]) < 1e-12 for p in fast.keys() & exact.keys())
    assert rt.topk_cells(queries, items.limit(0), k, threshold).count() == 0 and rt.topk_cells(queries.limit(0), items, k, threshold).count() == 0


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=32) * 0.3).tolist()) for i in range(1000)]
    items = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    centroids = rt.fit_cells(items, 40)
    assert rt.probes_needed(queries, items, centroids, 5, 0.7, 0.95) <= 8


def test_close_alias_equals_sequence_matching(spark):
    rng = random.Random(8)
    names = []
    for alias, _ in DEPARTMENT_ALIASES[:40]:
        chars = list(alias)
        for _ in range(rng.randint(0, 4)):
            chars[rng.randrange(len(chars))] = rng.choice("abcxyz ")
        names.append("".join(chars))
    names += ["ab", "zz", "Board of Nothing at All", "dgsx", "GSAA"]
    lower = {}
    for alias, name in DEPARTMENT_ALIASES:
        lower[alias.lower()] = name
    df = spark.createDataFrame([(n,) for n in names], "dept string")
    got = {r.dept: (r.canonical, r.ratio) for r in dep.fuzzy_department(df, dep.alias_table(spark), "dept", 0.8).collect()}
    for name in names:
        best = difflib.get_close_matches(name.lower(), list(lower), n=1, cutoff=0.8)
        assert got.get(name.lower(), (None,))[0] == (lower[best[0]] if best else None), name


def test_rules_name_known_tags(spark):
    assert tg.bad_rules(spark).count() == 0
    assert [r.tag for r in tg.bad_rules(spark, (("x", "Nope"),)).collect()] == ["Nope"]


def test_tagger_is_stored_and_loaded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tg, "FEATURE_BITS", 12)
    monkeypatch.setattr(tg, "TAG_VOCABULARY", ("Cloud", "Water", "Forestry"))
    rows = [(i, "cloud hosting platform service" if i % 2 else "drinking water supply pipes", ["Cloud"] if i % 2 else ["Water"]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, t string, l array<string>")
    first, trained = tg.load_or_train(df, "t", "l", str(tmp_path))
    again, loaded = tg.load_or_train(df, "t", "l", str(tmp_path))
    assert (trained, loaded) == ("trained", "loaded")
    assert first.constants == again.constants == {"Forestry": 0.0}
    probe = spark.createDataFrame([(1, "a cloud platform"), (2, "water pipes"), (3, " ")], "i int, t string")
    for model in (first, again):
        tags = {r.i: r.tags for r in model.predict(probe, "t").collect()}
        assert tags[1][0] == "Cloud" and tags[2][0] == "Water" and tags[3] == ["Cloud", "Water"]
    monkeypatch.setattr(tg, "TAG_VOCABULARY", ("Cloud", "Water"))
    assert tg.load_or_train(df, "t", "l", str(tmp_path))[1] == "trained"


def test_statement_and_deliverables_fallbacks(spark):
    row = [(1, "Network gear", "DEPT.Office of Roads", "", "Solicitation", "S-1", ["IT - network equipment", "IT - server maint"], ["Bidder list.pdf"])]
    df = spark.createDataFrame(row, "id int, title string, dept string, description string, event_type string, solicitation_number string, code_descriptions array<string>, labels array<string>")
    out = dv.deliverables(dv.statement_of_work(df.withColumn("name", dv.short_name("title", "dept")))).first()
    assert out.name == "Network gear (DEPT)"
    assert out.statement_of_work == "Solicitation for Network gear (DEPT) (solicitation S-1) issued by Office of Roads."
    assert out.deliverables == ["Provide network equipment", "Provide server maintenance"]
