"""The manifest against a tree built in one place."""

import random

import pytest
from pyspark.sql import functions as F

from tenderspark.llm import merkle
from tenderspark.llm.common import Scratch


def written(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, fanout):
    """The root of `nodes` and the proof of each, as (left, right) by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
        for proof, k in zip(proofs, at):
            run, own = runs[k // fanout], k % fanout
            proof.append(("".join(run[:own]), "".join(run[own + 1:])))
        at = [k // fanout for k in at]
        nodes = [merkle.digest("".join(r)) for r in runs]
    return nodes[0], proofs


def plain(rows, fanout):
    """`rows` of (doc_id, source, text): doc_id, leaf, subroot, root, proof, sorted."""
    by_source = {}
    for doc, source, text in rows:
        by_source.setdefault(source, []).append((doc is not None, doc, merkle.digest(written(doc, text))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s])], fanout) for s in order}
    root, above = climb([trees[s][0] for s in order], fanout)
    return sorted([(repr(doc), leaf, trees[s][0], root, tuple(proof + above[k])) for k, s in enumerate(order)
                   for (_, doc, leaf), proof in zip(sorted(by_source[s]), trees[s][1])])


def found(spark, rows, fanout, **more):
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, source string, text string, grp string, p int, blocks int")
    out = merkle.manifest(docs, "source", "doc_id", [F.col("doc_id"), F.col("text")], fanout=fanout, **more)
    return sorted((repr(r["key"]), r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in out.collect())


# With a fanout of 2 a block has 8 leaves, so some hundred rows make many rounds.
@pytest.mark.parametrize("fanout,sizes", [(2, [1, 2, 3, 8, 9, 200]), (2, [131]), (3, [1] * 30 + [27 * 9 + 1, 27 * 4]), (16, [1, 16, 17, 300])])
def test_equals_a_plain_tree(spark, fanout, sizes):
    rng = random.Random(1)
    rows = [(k * 7 - 30, f"s{i}", f"text {rng.random()}") for i, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    assert found(spark, rows, fanout) == plain(rows, fanout)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, None, None), (3, "", ""), (3, "", ""), (3, "", "b"), (None, "x", "a"), (None, "x", None), (5, "x", "é" * 3000), (6, "-", "a"), (7, "0", "a"),
            (8, "É", "a"), (9, "z", "\0"), (-4, "z", "-")]
    assert found(spark, rows, 2) == plain(rows, 2)
    assert found(spark, rows, 16) == plain(rows, 16)
    assert found(spark, rows[:1], 16) == plain(rows[:1], 16)
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, text string"), "source", "doc_id", [F.col("text")]).count() == 0


def test_a_group_in_many_ranges(spark):
    scratch = Scratch(spark, "test")
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("grp"), "id")
    placed, totals = merkle.positions(df.repartition(20), ["grp"], [F.col("id")], scratch)
    got = {}
    for r in placed.collect():
        got.setdefault(r["grp"], []).append((r["id"], r["pos"]))
    assert all([p for _, p in sorted(x)] == list(range(len(x))) for x in got.values())
    assert {r["grp"]: r["total"] for r in totals.collect()} == {g: len(x) for g, x in got.items()}


def test_a_changed_leaf_does_not_verify(spark):
    rows = [(k, "s", f"Text {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    fields = [F.col("doc_id"), F.col("text")]
    changed = F.when(F.col("doc_id") % 10 == 0, merkle.leaf_hash(F.col("doc_id"), F.lower("text")))
    out = merkle.verified(merkle.manifest(docs, "source", "doc_id", fields, changed, fanout=4)).collect()
    assert {r["key"] for r in out if not r["verified"]} == set(range(0, 100, 10)) and len({r["root"] for r in out}) == 1
    assert all(r["folded_root"] != r["root"] for r in out if not r["verified"])
