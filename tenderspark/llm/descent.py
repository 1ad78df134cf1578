"""Embedding near-dedup by NN-descent.

Rows with the same label and vector are one node.  Neighbour lists start from
tables of random hyperplanes: nodes of a label that fall on the same sides are
compared with the next few of their bucket, in the order of a random direction of
the table.  The number of tables follows from the sides and the threshold, so that
a pair at the threshold that nothing else links to meets in one of them with the
recall asked for, whatever the size of its label.  Then lists are refined by
neighbours-of-neighbours joins: whatever two nodes stand in one list are compared,
and each keeps its nearest, until the lists hardly change.  Only neighbours that
can lead to a link are held: a node within the link angle of a neighbour of mine
that links with me is within twice the angle.

Links of the lists, checked in double precision, join nodes to components.  A full
list may hide further links, so it is enlarged to its whole component: the members
of every component are compared exactly, in blocks, and only counts leave a task.
A bounded sample of nodes is compared with all rows to audit the recall of a node
with links, apart for nodes with few and with many of them, so that a large group
can't hide what pairs lose; while either is below `recall`, further tables are added.

Vectors that are null, empty, zero or hold a null or non-finite component, and
those whose label is null, link with nothing and stay.  So do rows with a null id.
Rows that share an id are one vector with the links of all of them.  An empty
table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, runs
from tenderspark.llm.groups import between, compare_blocks, components, in_blocks
from tenderspark.llm.vectors import matrix, unit, vectors

TABLES = 32
AHEAD = 8
LIST = 16
ROUGH = 0.03  # more than a cosine of vectors of 8-bit components can be off
SAMPLE = 512
ENOUGH = 256  # audited nodes with few links, if `MOST_SAMPLED` nodes hold so many
MOST_SAMPLED = 4096
BLOCK = 2048

BUCKETED = pa.schema([("key", pa.int64()), ("along", pa.float32()), ("id", pa.int64()), ("small", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float32())])
PAIR_SQL = "a long, b long, score float"


def rough(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 8-bit components."""
    return np.round(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _unit32(column) -> np.ndarray:
    x = np.array([np.frombuffer(v, np.int8) for v in column.to_pylist()], np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bucket(tables: range, bits: int):
    """A row for each table: bucket, place along a direction, node, and its 8-bit vector."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([6, tables[0], dim]).normal(size=(dim, len(tables) * (bits + 1)))
                step = max(50, 1_000_000 // (len(tables) * bits))
                for low in range(0, part.num_rows, step):
                    some = part.slice(low, step)
                    x = unit(matrix(some.column(2), dim))
                    height = (x @ planes[dim]).reshape(len(x), len(tables), bits + 1)
                    side = height[:, :, :bits] > 0
                    code = (side @ (np.int64(1) << np.arange(bits, dtype=np.int64))).astype(np.int64)
                    salt = np.array([[hash((g, t)) for t in tables] for g in some.column(1).to_pylist()], np.int64)
                    key = (code * np.int64(-7046029254386353131)) ^ salt
                    small = [v.tobytes() for v in rough(x)]
                    yield batch_of(BUCKETED, key=key.reshape(-1), along=height[:, :, bits].astype(np.float32).reshape(-1), id=np.repeat(some.column(0).to_numpy(), len(tables)), small=[s for s in small for _ in tables])

    return work


def _ahead(floor: float):
    """Compares each row with the next `AHEAD` of its bucket."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, vecs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 1), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(3).to_pylist()
            width = max(map(len, column))
            x = np.array([np.pad(np.frombuffer(v, np.int8), (0, width - len(v))) for v in column], np.float32)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            wide = max(width, vecs.shape[1])
            keys, ids = np.append(keys, batch.column(0).to_numpy()), np.append(ids, batch.column(2).to_numpy())
            vecs = np.concatenate([np.pad(vecs, ((0, 0), (0, wide - vecs.shape[1]))), np.pad(x, ((0, 0), (0, wide - width)))])
            fresh = len(keys) - batch.num_rows
            out = []
            for step in range(1, AHEAD + 1):
                later = np.arange(max(fresh, step), len(keys))
                later = later[keys[later] == keys[later - step]]
                score = np.einsum("nd,nd->n", vecs[later], vecs[later - step])
                hit = (score >= floor) & (ids[later] != ids[later - step])
                out.append((ids[later[hit]], ids[later[hit] - step], score[hit]))
            a, b, s = (np.concatenate(c) for c in zip(*out))
            if len(a):
                yield batch_of(PAIR, a=np.minimum(a, b), b=np.maximum(a, b), score=s)
            keys, ids, vecs = keys[-AHEAD:], ids[-AHEAD:], vecs[-AHEAD:]

    return work


def _meet(floor: float):
    """Compares all pairs of each list, which holds `LIST` entries and the node itself at most."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table in runs(batches, ("v",)):
            if table.num_rows < 2:
                continue
            ids, least = table["id"].to_numpy(), table["least"].to_numpy()
            x = _unit32(table["small"])
            score = x @ x.T
            a, b = np.nonzero(np.triu((score >= floor) & ((score > least[:, None]) | (score > least[None, :])), 1))
            out.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), score[a, b]))
            if sum(len(o[0]) for o in out) > 50_000:
                yield batch_of(PAIR, **dict(zip("ab", map(np.concatenate, list(zip(*out))[:2]))), score=np.concatenate([o[2] for o in out]))
                out = []
        if out:
            yield batch_of(PAIR, **dict(zip("ab", map(np.concatenate, list(zip(*out))[:2]))), score=np.concatenate([o[2] for o in out]))

    return work


def cosine_links(threshold: float) -> Callable[[pa.Table, np.ndarray | None], np.ndarray]:
    def linked(table: pa.Table, side: np.ndarray | None) -> np.ndarray:
        x = unit(matrix(table["vec"], table["dim"][0].as_py()))
        return between(side, len(x), lambda a, b: x[a] @ x[b].T >= threshold)

    return linked


def _exact(threshold: float):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if a:
                dims = np.array(list(map(len, a)))
                hit = np.zeros(len(a), bool)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x, y = (unit(np.frombuffer(b"".join([c[i] for i in at]), np.float64).reshape(len(at), -1)) for c in (a, b))
                    hit[at] = np.einsum("nd,nd->n", x, y) >= threshold
                yield batch.select(["a", "b"]).filter(pa.array(hit))

    return work


def _top(pairs: DataFrame, most: int) -> DataFrame:
    """``v, u, score``: each node's nearest, `most` of them."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), "score"),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("u"), "score"))).alias("e")).select("e.*")
    order = Window.partitionBy("v").orderBy(F.desc("score"), "u")
    return both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def _refine(pairs: DataFrame, small: DataFrame, floor: float, scratch: Scratch) -> DataFrame:
    """Neighbours-of-neighbours joins until fewer than one list entry in a hundred is new."""
    lists = scratch.stage(_top(pairs, LIST), "lists")
    count = lists.count()
    while count:
        least = lists.groupBy("v").agg(F.when(F.count(F.lit(1)) >= LIST, F.min("score")).otherwise(F.lit(-1.0)).cast("float").alias("least"))
        entries = lists.select("v", F.col("u").alias("id")).unionByName(lists.select("v", F.col("v").alias("id")).distinct())
        entries = entries.join(small, "id").join(least.withColumnRenamed("v", "id"), "id").select("v", "id", "least", "small")
        found = map_arrow(entries.repartition("v").sortWithinPartitions("v", "id"), _meet(floor), PAIR_SQL)
        known = lists.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), "score")
        merged = found.unionByName(known).groupBy("a", "b").agg(F.max("score").alias("score"))
        before, lists = lists, scratch.stage(_top(merged, LIST), "lists")
        fresh, count = lists.join(before, ["v", "u"], "left_anti").count(), lists.count()
        scratch.drop(before)
        if fresh <= 0.01 * count:
            break
    return lists.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), "score").distinct()


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables in which two vectors at the threshold share a bucket once or more; half of the loss that `recall` allows is left to the lists."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return TABLES if same >= 1 else max(TABLES, math.ceil(math.log((1 - recall) / 2) / math.log1p(-same)))


def recall_of_nodes(true: dict[int, tuple[int, int]], found: dict[int, int]) -> float:
    """The mean share of its links that a node has found: of nodes linked with up to `LIST` others or of the rest, whichever is less."""
    few, many = [], []
    for i, (n, others) in true.items():
        if n:
            (few if others <= LIST else many).append(min(n, found.get(i, 0)) / n)
    return min((math.fsum(shares) / len(shares) for shares in (few, many) if shares), default=1.0)


def _true_links(classes: DataFrame, threshold: float) -> dict[int, tuple[int, int]]:
    """Links, and nodes linked with, of sampled nodes by comparison with all rows; the sample grows until `ENOUGH` of them have few links."""
    true: dict[int, tuple[int, int]] = {}
    size = SAMPLE
    while True:
        rows = classes.orderBy(F.xxhash64("id", F.lit(6)), "id").limit(size).select("id", "grp", "vec").collect()
        sample = [(r["id"], r["grp"], r["vec"]) for r in rows if r["id"] not in true]
        counted = map_arrow(classes.select("id", "grp", "vec", "weight"), _audit(sample, threshold), "id long, n long, others long")
        true |= {r["id"]: (r["n"], r["others"]) for r in counted.groupBy("id").agg(F.sum("n").alias("n"), F.sum("others").alias("others")).collect()}
        if len(rows) < size or size >= MOST_SAMPLED or sum(0 < others <= LIST for _, others in true.values()) >= ENOUGH:
            return true
        size *= 2


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.93, recall: float = 0.99, most_tables: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector; links have a cosine of at least `threshold` within a label.

    `recall` is that of the links of a node, audited on `SAMPLE` to `MOST_SAMPLED`
    nodes; `most_tables` (eight times those it starts with) ends a search that
    can't reach it, with an error.
    """
    scratch = Scratch(df.sparkSession, "descent")
    rows = scratch.stage(vectors(df), "vectors")
    held = rows.filter("vec is not null and label is not null and vec_id is not null")
    group = F.xxhash64("label", "dim")
    classes = (held.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight"))
               .select("id", group.alias("grp"), "vec", "dim", "weight"))
    classes = scratch.stage(classes, "classes")
    sizes = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    small = scratch.stage(map_arrow(classes.select("id", "vec", "dim"), _small, "id long, small binary"), "small")
    bits = max(4, min(40, math.ceil(math.log2(sizes + 1))))
    floor = float(2 * threshold * threshold - 1) - ROUGH
    true = _true_links(classes, threshold)
    pairs = None
    first = tables_for(bits, threshold, recall)
    most_tables = 8 * first if most_tables is None else most_tables
    for tables in [0, *range(first, most_tables, TABLES)]:
        keyed = map_arrow(classes.select("id", "grp", "vec", "dim"), _bucket(range(tables, tables + TABLES if tables else first), bits),
                          "key long, along float, id long, small binary")
        near = map_arrow(keyed.repartition("key").sortWithinPartitions("key", "along", "id"), _ahead(floor), PAIR_SQL)
        near = scratch.stage(near.groupBy("a", "b").agg(F.max("score").alias("score")), "near")
        pairs = near if pairs is None else scratch.stage(pairs.unionByName(near).groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
        refined = _refine(pairs, small, floor, scratch)
        hopeful = refined.unionByName(pairs).filter(F.col("score") >= threshold - ROUGH).select("a", "b").distinct()
        of = classes.select("id", "vec")
        checked = (hopeful.join(of.toDF("a", "va"), "a").join(of.toDF("b", "vb"), "b").select("a", "b", "va", "vb"))
        joined = components(map_arrow(checked, _exact(threshold), "a long, b long"), scratch)
        members = classes.drop("grp").join(joined.withColumnRenamed("component", "grp"), "id").withColumn("n", F.lit(1))
        links = scratch.stage(compare_blocks(in_blocks(scratch.stage(members, "members"), "n", BLOCK), cosine_links(threshold)).groupBy("id").agg(F.sum("links").alias("links")), "links")
        found = {r["id"]: r["links"] for r in links.filter(F.col("id").isin(list(true))).collect()}
        if recall_of_nodes(true, found) >= recall:
            break
    else:
        raise RuntimeError(f"{most_tables} tables don't reach a recall of {recall}")
    of_class = (classes.join(joined, "id", "left").join(links, "id", "left")
                .select(F.col("id").alias("class_id"), "grp", "vec", F.coalesce("component", "id").alias("component"),
                        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    of_row = (held.withColumn("grp", group).join(of_class, ["grp", "vec"]).groupBy("vec_id")
              .agg(F.min("component").alias("component"), F.max("n_links").alias("n_links")))
    return (rows.select("vec_id").join(of_row, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept")))


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = [rough(unit(np.frombuffer(v, np.float64)[None, :]))[0].tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["id", "small"])


def _audit(sample: list[tuple[int, int, bytes]], threshold: float):
    """Exact numbers of links of the sampled nodes, and of nodes they are linked with, from the rows of a task."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, others = ({i: 0 for i, _, _ in sample} for _ in range(2))
        own = {}
        for g in {g for _, g, _ in sample}:
            names = [i for i, own_g, _ in sample if own_g == g]
            own[g] = names, unit(np.frombuffer(b"".join([v for _, own_g, v in sample if own_g == g]), np.float64).reshape(len(names), -1))
        for batch in batches:
            ids, grps, weights = (batch.column(k).to_numpy() for k in (0, 1, 3))
            vecs = batch.column(2).to_pylist()
            for g in own.keys() & set(grps.tolist()):
                names, y = own[g]
                every = np.flatnonzero(grps == g)
                step = max(1, 2_000_000 // len(names))
                for low in range(0, len(every), step):
                    at = every[low:low + step]
                    x = unit(np.frombuffer(b"".join([vecs[i] for i in at]), np.float64).reshape(len(at), -1))
                    hit = (y @ x.T >= threshold) & (np.array(names)[:, None] != ids[at][None, :])
                    for i, n, k in zip(names, (hit @ weights[at]).tolist(), hit.sum(1).tolist()):
                        total[i] += n
                        others[i] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(d), pa.int64()) for d in (total, total.values(), others.values())], names=["id", "n", "others"])

    return work
