import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tenderspark.llm import mixing, packing, quality
from tenderspark.llm.common import Scratch, read, texts


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [100, 1, 1, 1], [k + 1 for k in range(40)]])
def test_schedule_stays_within_a_block(weights):
    slots = mixing.shares([float(w) for w in weights], 360)
    assert sum(slots) == 360
    assert mixing.deviation(mixing.schedule(slots) * 2, [Fraction(s, 360) for s in slots]) < 1


def test_phases_place_every_block_once():
    rng = random.Random(2)
    for _ in range(30):
        blocks = [rng.randint(0, 60) for _ in range(rng.randint(1, 8))]
        plan = mixing.phases(blocks, [rng.random() + 0.01 for _ in blocks], 64)
        slots = sorted(int(s) for i, n in enumerate(blocks) if n for s in mixing._slots(plan, i, np.arange(n)))
        assert slots == list(range(sum(blocks)))


def order_of(blocks, plan):
    out = np.empty(sum(blocks), np.int64)
    for i, n in enumerate(blocks):
        out[mixing._slots(plan, i, np.arange(n))] = i
    return out


def test_schedule_follows_the_target_weights():
    for weights in ([9, 1], [1999, *[2] * 1999]):
        total = sum(weights)
        blocks = [w * (60_000 // total + 1) for w in weights]
        order = order_of(blocks, mixing.phases(blocks, [w / total for w in weights], 4096))
        for i in range(2):
            done = np.cumsum(order == i)
            assert np.abs(done - weights[i] / total * np.arange(1, len(order) + 1)).max() < 1


def test_schedule_follows_the_ideal_mixture_when_sources_end():
    rng = random.Random(4)
    for _ in range(10):
        blocks, weights = zip(*((rng.randint(1, 40), rng.randint(1, 30)) for _ in range(12)))
        order = order_of(blocks, mixing.phases(list(blocks), list(weights), 64))
        ideal, done = [Fraction(0)] * 12, [0] * 12
        for i in order.tolist():
            spare = Fraction(1)  # of this slot
            while spare:
                left = [k for k in range(12) if ideal[k] < blocks[k]]
                total = sum(weights[k] for k in left)
                step = min(spare, *(Fraction((blocks[k] - ideal[k]) * total, weights[k]) for k in left))
                for k in left:
                    ideal[k] += step * weights[k] / total
                spare -= step
            done[i] += 1
            assert all(abs(a - b) < 1 for a, b in zip(done, ideal))


def test_mixture(spark):
    rows = [(i, "abc"[min(2, i * i % 7 % 3)] if i % 50 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, position int")
    out = sorted(mixing.mix(df, {"a": 3, "b": 2, "c": 1, None: 0.5}, block=8, period=256).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(1000)) and sorted(r["doc_id"] for r in out) == list(range(1000))
    assert len({(r["source"], r["block"]) for r in out}) == len({r["slot"] for r in out})
    # Until a source ends, each has less than a block more or fewer than its share.
    order = [r["source"] for r in out[::8]][:20]
    share = {"a": 3 / 6.5, "b": 2 / 6.5, "c": 1 / 6.5, None: 0.5 / 6.5}
    for t in range(1, 20):
        assert all(abs(order[:t].count(s) - w * t) < 1.1 for s, w in share.items())
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1})


def test_mixture_of_odd_rows(odd):
    out = mixing.mix(odd, block=2).collect()
    assert sorted(r["position"] for r in out) == list(range(odd.count()))


def test_pieces():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_bound_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(1, 101, rng.integers(1, 12))
        bins, offsets, room = packing.best_fit(lengths, 100)
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        for b in range(len(room)):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert offsets[at].tolist() == np.cumsum([0, *lengths[at][:-1]]).tolist() and lengths[at].sum() + room[b] == 100
        assert bound <= fewest(lengths.tolist(), 100) <= len(room)
    # Sizes just above a half or a third need more bins than their sum.
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


def fewest(lengths, capacity):
    """Fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for r in set(bins):
            if r >= lengths[k]:
                rest = list(bins)
                rest[rest.index(r)] -= lengths[k]
                go(k + 1, rest)
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= capacity
    return len(bins)


@pytest.mark.parametrize("part", [None, "pmod(xxhash64(doc_id), 5)"])
def test_repacking_lowers_the_number_of_bins(spark, part):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                  (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    df = df.withColumn("part", F.lit(None).cast("long") if part is None else F.expr(part))
    rows = packing.pack(df, 1000, Scratch(spark, "test"), per_part=200, given_up=20, width=2).collect()
    assert len(rows) == 3000
    need = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=1001), 1000)
    assert need <= check_packed(rows, 1000) <= need + 2


def test_unlike_parts_exchange_all_their_bins(spark):
    # Texts just over half a sequence in one part, small ones in the other.
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                  F.when(F.col("id") < 1000, 550).otherwise(400).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
                                  F.when(F.col("id") < 1000, 0).otherwise(1).cast("long").alias("part"))
    rows = packing.pack(df, 1000, Scratch(spark, "test"), per_part=500).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000))
    assert check_packed(rows, 1000) <= 1050  # a bin for each of the larger texts at least; 1500 without any exchange


def test_packing_of_odd_rows(odd, path):
    rows = packing.pack_documents(odd, path, 64).collect()
    check_packed(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert packing.pack_documents(odd.limit(0), path, 64).count() == 0


def test_quality_on_the_held_out_fold(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    right = got["predicted"] == got["quality"]
    assert right.mean() > 0.97 and right[got["quality"] == 1].mean() > 0.99 and right[got["quality"] == 0].mean() > 0.85


def test_quality_of_odd_rows(spark, odd, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.score(odd.limit(0), model).count() == 0
    nothing = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert quality.score(odd, nothing).count() == odd.count()
    long = quality.Scorer(model)
    assert long.scores(["word " * 9, "word " * 9]) == quality.Scorer(model, held=1).scores(["word " * 9] * 2)


def test_pipeline_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, scratch = docs.columns, Scratch(spark, "test")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in texts(docs).collect()}
    check_packed(placed, 2048)


def test_pipeline_of_odd_rows(spark, odd, sf_dir):
    rows = odd.withColumn("n_chars", F.lit(0).cast("long"))
    given = rows.count()
    out = {name: stage(spark, rows, sf_dir).collect() for name, stage in corpus_pipeline.STAGES}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), sf_dir).count() == 0
    assert len(out["quality"]) <= given
    # Document 8 keeps the one line that no other document has before it; rows without any line stay only where nothing was taken.
    (rest,) = [r["text"] for r in out["lines"] if r["doc_id"] == 8]
    assert rest == "something else here"
    # One of the documents with the same sixty words stays; what has no text or no id stays.
    kept = [r["doc_id"] for r in out["near duplicates"]]
    assert 4 in kept and 5 not in kept and {2, 3, None} <= set(kept)
    assert len(out["mixture"]) == given
    assert {r["doc_id"] for r in out["packing"]} == {r["doc_id"] for r in rows.collect()}


def test_all_queries_are_registered(spark, sf_dir):
    queries = __spark_entry__.queries()
    for n in range(1, 14):
        (name,) = [q for q in queries if q.startswith(f"op{n}_")]
        if n in (1, 2, 4, 5, 6):
            assert queries[name](spark, sf_dir).count() > 0
    assert "pipeline" in queries
