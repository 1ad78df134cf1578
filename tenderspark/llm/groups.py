"""Connected components by repeated contraction, and exact comparison of all members of a group in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, map_arrow, runs

MEMBERS = 500  # of a block, so the matrices of two blocks take a few MB


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` of every id in ``edges(a, b)``: the smallest id that links lead to.

    Distributed union-find: in each round every node that still has edges hooks
    onto its smallest neighbour, pointers are doubled twice, and the edges are
    moved to the nodes pointed at.  A round at least halves these nodes.  The hooks
    of all rounds are kept and put together from the last one back, so the rows of
    all rounds and joins are a few times the nodes.  Ids may be of any type with an
    order.  Rows with a null end and self-links are left out.  No edges: no rows.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
    edges = scratch.stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        hooks = edges.select(both).groupBy("e.v").agg(F.least(F.min("e.v"), F.min("e.w")).alias("p")).select("v", "p")
        for _ in range(2):  # whatever is pointed at is a node as well
            target = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hooks = hooks.join(target, "p").select("v", F.col("pp").alias("p"))
        hooks = scratch.stage(hooks, "hooks")
        rounds.append(hooks)
        left, right = hooks.toDF("a", "pa"), hooks.toDF("b", "pb")
        before = edges
        edges = scratch.stage(edges.join(left, "a").join(right, "b").filter("pa <> pb")
                              .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        scratch.drop(before)
    scratch.drop(edges)
    labels = rounds.pop().toDF("id", "component")
    while rounds:
        after = labels.select(F.col("id").alias("p"), F.col("component").alias("root"))
        labels = scratch.stage(rounds.pop().join(after, "p", "left").select(F.col("v").alias("id"), F.coalesce("root", "p").alias("component")), "labels")
    return labels


def in_blocks(members: DataFrame, size: str, limit: int, sizes: DataFrame | None = None, most: int = MEMBERS) -> DataFrame:
    """Deals the members of each ``grp`` into blocks of about `limit` (summed `size`) and `most` members and copies each to the pairs of blocks it belongs to.

    Adds ``i, j, side``: a row for every pair i <= j of blocks of its group with
    its own among them; `side` says which.  A group within both limits is one
    block and its members are not copied; else a member is copied as often as its
    group has blocks.  `sizes` may give ``grp`` and `size` without the rest.  A
    task holds two blocks at once, however large the group.
    """
    counted = F.sum(F.greatest(F.col(size), F.lit(limit / most)))
    totals = (members if sizes is None else sizes).groupBy("grp").agg(F.ceil(counted / F.lit(limit)).cast("int").alias("_nb"))
    own = members.join(totals.filter("_nb > 1"), "grp", "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    own = own.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    return (own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
            .withColumn("side", F.when(F.col("_own") == F.col("i"), 0).otherwise(1)).drop("_nb", "_own", "_other"))


def compare_blocks(blocks: DataFrame, linked: Callable[[pa.Table, np.ndarray | None], np.ndarray]) -> DataFrame:
    """``id, other, links``: for each member of a block pair that links with any the summed ``weight`` of these, and one it hangs together with.

    `linked(table, side)` gives the boolean matrix of links; `side` is None inside
    one block.  The links returned only span the connected parts, so they are
    fewer than the members.
    """
    kind = blocks.schema["id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        rows = 0
        for table in runs(batches, ("grp", "i", "j")):
            if table.num_rows < 2:
                continue
            side = table["side"].to_numpy() if table["i"][0].as_py() != table["j"][0].as_py() else None
            hit = linked(table, side)
            np.fill_diagonal(hit, False)
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            hit = hit[some][:, some]
            links = hit @ table["weight"].to_numpy().astype(np.float64)[some]
            label = np.arange(len(some))
            while True:
                new = np.minimum(label, np.where(hit, label[None, :], len(some)).min(axis=1))
                if (new == label).all():
                    break
                label = new
            ids = table["id"].combine_chunks().take(pa.array(some))
            held.append([ids, ids.take(pa.array(label)), pa.array(links.astype(np.int64))])
            rows += len(some)
            if rows > 50_000:
                yield _links(held)
                held, rows = [], 0
        if held:
            yield _links(held)

    dealt = blocks.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")
    return map_arrow(dealt, work, f"id {kind}, other {kind}, links long")


def span_blocks(blocks: DataFrame, spanned: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> DataFrame:
    """``id, other``: links that connect whatever links connect in a pair of blocks, fewer than its members.

    `spanned(table)` gives them by the places of their ends.  Links inside a block
    may come from each pair that it belongs to, which changes no component.
    """
    kind = blocks.schema["id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        rows = 0
        for table in runs(batches, ("grp", "i", "j")):
            if table.num_rows < 2:
                continue
            if found := list(spanned(table)):
                ids = table["id"].combine_chunks()
                held.append([ids.take(pa.array(end)) for end in zip(*found)])
                rows += len(found)
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], names=["id", "other"])
                held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], names=["id", "other"])

    dealt = blocks.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")
    return map_arrow(dealt, work, f"id {kind}, other {kind}")


def jaccard_span(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """Links of exact Jaccard of at least `threshold` (above 0) that connect what such links connect, without a look at all pairs.

    With its values in one order, the rarest first, a set shares one of its first
    ``size - ceil(threshold * size) + 1`` with whatever it links with, and from the
    first shared one on both have enough left.  Sets are taken along links; a set
    that has been reached is not looked at again.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if both / max(len(sets[0]) + len(sets[1]) - both, 1) >= threshold:
            yield 0, 1
        return
    size = np.array([len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(count), np.int64)
    order[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner, value = np.repeat(np.arange(n), size), order[value]
    at = np.lexsort((value, owner))
    value, count = value[at], np.sort(count)
    start = np.cumsum(size) - size
    first = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    place = np.arange(len(value)) - np.repeat(start, size)
    begins = (place < np.repeat(first, size)) & (count[value] > 1)
    begin_value, begin_owner = value[begins], owner[begins]
    rest = size[begin_owner] - place[begins]  # values from there on
    ends = np.cumsum(np.bincount(begin_owner, minlength=n))
    by = np.argsort(begin_value, kind="stable")
    known, cut = np.unique(begin_value[by], return_index=True)
    waiting = dict(zip(known.tolist(), np.split(by, cut[1:])))  # where sets not reached yet begin with a value
    left, marked = np.ones(n, bool), np.zeros(len(count), bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        reached = [root]
        while reached:
            v = reached.pop()
            near, most = [], []
            for e in range(ends[v - 1] if v else 0, ends[v]):
                held = waiting[begin_value[e]]
                waiting[begin_value[e]] = held = held[left[begin_owner[held]]]
                near.append(begin_owner[held])
                most.append(np.minimum(rest[held], rest[e]))
            if not near:
                continue
            near, at = np.unique(np.concatenate(near), return_index=True)  # the first value that both have: none before it is shared
            near = near[np.concatenate(most)[at] >= threshold / (1 + threshold) * (size[near] + size[v]) - 1e-9]
            if not len(near):
                continue
            own = value[start[v]:start[v] + size[v]]
            marked[own] = True
            for a in range(0, len(near), 1024):
                part = near[a:a + 1024]
                edge = np.cumsum(size[part]) - size[part]
                where = np.arange(int(size[part].sum())) - np.repeat(edge, size[part]) + np.repeat(start[part], size[part])
                both = np.add.reduceat(marked[value[where]], edge, dtype=np.int64)
                linked = part[both / (size[part] + size[v] - both) >= threshold]
                left[linked] = False
                reached += linked.tolist()
                yield from ((v, w) for w in linked.tolist())
            marked[own] = False


def _links(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], names=["id", "other", "links"])


def stored_sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in table["items"].to_pylist()]


def jaccard_links(threshold: float, sets_of: Callable[[pa.Table], list[np.ndarray]] = stored_sets) -> Callable[[pa.Table, np.ndarray | None], np.ndarray]:
    """Links between sets of distinct 64-bit hashes, which `sets_of` takes from a table: exact Jaccard of at least `threshold`."""
    def linked(table: pa.Table, side: np.ndarray | None) -> np.ndarray:
        sets = sets_of(table)
        size = np.array([len(s) for s in sets])

        def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = shared(sets, size, a, b)
            return both / np.maximum(size[a][:, None] + size[b][None, :] - both, 1) >= threshold

        return between(side, len(sets), similar)

    return linked


def between(side: np.ndarray | None, n: int, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The links of `n` members: all that `similar` finds among them, or with `side` only those from one side to the other."""
    if side is None:
        return similar(np.arange(n), np.arange(n))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    hit = np.zeros((n, n), bool)
    if len(a) and len(b):
        found = similar(a, b)
        hit[np.ix_(a, b)] = found
        hit[np.ix_(b, a)] = found.T
    return hit


def shared(sets: list[np.ndarray], size: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `rows` with the sets `cols`."""
    n = len(sets)
    if n == 2:
        m = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[size[0], m], [m, size[1]]], dtype=np.float64)[np.ix_(rows, cols)]
    owner = np.repeat(np.arange(n), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(start, len(values)))
    both = np.zeros((len(rows), len(cols)), dtype=np.float32)
    everywhere = count == n  # held by all: a constant
    both += float(everywhere.sum())
    keep = (count > 1) & ~everywhere
    owner = owner[np.repeat(keep, count)]
    column = np.repeat(np.arange(int(keep.sum())), count[keep])
    for low in range(0, int(keep.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((n, min(4096, int(keep.sum()) - low)), dtype=np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += held[rows] @ held[cols].T
    return both.astype(np.float64)
