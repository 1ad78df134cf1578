"""Merkle manifest of a table by a butterfly exchange between blocks.

A row is a leaf: the hash of its fields.  Leaves of a group lie in the order of
their key, and every `fanout` nodes in a row (the last run may be shorter) become
their hash until one, the subtree of the group, is left; the subtrees, in the
order of their groups, become the root in the same way.

Leaves are dealt into blocks of ``fanout ** LEVELS`` consecutive ones, so a block
is a whole subtree.  Blocks then exchange their nodes round by round: in round r
every block swaps its node with the ones whose number differs in digit r (to the
base `fanout`) alone, and hashes the ancestor that they share by itself.  After
the last round every block holds the whole upper part of its proofs; nothing is
passed down the tree.  The number of blocks is filled up with empty ones to a
multiple of the last round's stride, so that everyone has its partners; they
receive and pass on nodes like others.  The subtrees of the groups exchange theirs
in the same way, as blocks of one node.

A leaf hashes its fields one after the other: `-` for a null, else the number of
bytes of its UTF-8 form, a colon and the form itself.  Null groups come first, so
do null keys; rows that repeat a key are ordered by their leaf.  Equal rows are
leaves of their own.  An empty table gives no rows.  Columns not named as fields
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, map_arrow

LEVELS = 3  # of the tree inside a block
PROOF = "array<struct<left:string,right:string>>"
_NODES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
PROVEN = pa.schema([("grp", pa.string()), ("key", pa.int64()), ("leaf", pa.string()), ("carry", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", _NODES)])


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row's fields."""
    def written(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[Column], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`rows` with their ``pos`` (from 0) in the order of their group, and the number of rows ``total`` of each group.

    Rows are dealt by ranges of the whole order and numbered where they lie; only
    the number of rows of each group in each range is summed up, so a group may
    fill any number of partitions.  `group` columns must not be null.
    """
    dealt = rows.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*group, *order)
    row = F.monotonically_increasing_id()
    numbered = scratch.stage(dealt.withColumn("_row", row), "numbered").withColumn("_range", F.shiftright("_row", 33))
    ranges = numbered.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first")
    starts = scratch.stage(starts, "starts")
    placed = numbered.join(starts.drop("_n"), [*group, "_range"]).withColumn("pos", F.col("_row") + F.col("_start")).drop("_row", "_range", "_start")
    return placed, starts.groupBy(*group).agg(F.sum("_n").alias("total"))


def rounds_of(blocks: Column, fanout: int) -> Column:
    """How often `blocks` nodes are hashed together until one is left."""
    step = F.lit(0)
    for k in range(math.ceil(63 / math.log2(fanout))):
        step = step + F.when(blocks > fanout ** k, 1).otherwise(0)
    return step


def exchange(nodes: DataFrame, fanout: int, scratch: Scratch) -> DataFrame:
    """``grp, p, top, proof`` from ``grp, p, blocks, node``: the root of each group of blocks and the upper part of each block's proof.

    `p` numbers the blocks of a group from 0 and `blocks` is their number.  Proofs
    are lists of the nodes to the left and to the right, level by level.
    """
    state = nodes.withColumn("rounds", rounds_of(F.col("blocks"), fanout))
    stride = F.pow(F.lit(fanout), F.greatest(F.col("rounds") - 1, F.lit(0))).cast("long")
    state = state.withColumn("width", F.ceil(F.col("blocks") / stride).cast("long")).withColumn("filled", F.col("width") * stride)
    # Empty blocks are fewer than the others: each makes one of them at most.
    own = F.struct(F.col("p"), F.col("node"))
    empty = F.struct((F.col("p") + F.col("blocks")).alias("p"), F.lit(None).cast("string").alias("node"))
    state = state.withColumn("_own", F.explode(F.when(F.col("p") + F.col("blocks") < F.col("filled"), F.array(own, empty)).otherwise(F.array(own))))
    state = scratch.stage(state.select("grp", "blocks", "rounds", "width", F.col("_own.p").alias("p"), F.col("_own.node").alias("node"),
                                       F.array().cast(PROOF).alias("proof")), "state")
    most = state.agg(F.max("rounds")).first()[0] or 0
    done = [state.filter("rounds = 0")]
    for r in range(most):
        stride = fanout ** r
        busy = state.filter(F.col("rounds") > r)
        place = F.floor(F.col("p") / F.lit(stride)).cast("long") % fanout
        partners = F.when(F.col("rounds") == r + 1, F.col("width")).otherwise(F.lit(fanout))
        sent = (busy.withColumn("place", place).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), partners - 1)))
                .select("grp", (F.col("p") + (F.col("to") - F.col("place")) * stride).alias("p"), F.struct("place", "node").alias("got"),
                        F.when(F.col("to") == F.col("place"), F.struct("blocks", "rounds", "width", "place", "proof")).alias("own")))
        # No block gets more than `fanout` nodes.
        held = sent.groupBy("grp", "p").agg(F.array_sort(F.collect_list("got")).alias("got"), F.max_by("own", F.col("own").isNotNull()).alias("own"))
        known = F.filter("got", lambda x: x["node"].isNotNull())
        left = F.array_join(F.transform(F.filter(known, lambda x: x["place"] < F.col("own.place")), lambda x: x["node"]), "")
        right = F.array_join(F.transform(F.filter(known, lambda x: x["place"] > F.col("own.place")), lambda x: x["node"]), "")
        node = F.when(F.size(known) > 0, F.sha2(F.array_join(F.transform(known, lambda x: x["node"]), ""), 256))
        state = scratch.stage(held.select("grp", "own.blocks", "own.rounds", "own.width", "p", node.alias("node"),
                                          F.concat("own.proof", F.array(F.struct(left.alias("left"), right.alias("right")))).alias("proof")), "state")
        done.append(state.filter(F.col("rounds") == r + 1))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.filter("p < blocks").select("grp", "p", F.col("node").alias("top"), "proof")


def levels(nodes: list[str], fanout: int, full: bool) -> list[list[str]]:
    """A block's nodes level by level, as the joined runs they are hashed in; the last level is the block's node.  `full`: all `LEVELS` of them, even for one node."""
    out = []
    while len(nodes) > 1 or (full and len(out) < LEVELS):
        out.append(["".join(nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)])
        nodes = [digest(x) for x in out[-1]]
    return [*out, nodes]


def _nodes(fanout: int):
    """The node of each block."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [levels([x["leaf"] for x in rows], fanout, blocks > 1)[-1][0] for blocks, rows in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(node, pa.string())], names=["grp", "p", "blocks", "node"])

    return work


def _proofs(fanout: int):
    """A row for each leaf of a block, with its whole proof: the part inside the block and then the block's."""
    width = 64  # characters of a digest

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = row["rows"]
                own = levels([x["leaf"] for x in leaves], fanout, row["blocks"] > 1)[:-1]
                for part in itertools.batched(range(len(leaves)), 512):
                    proofs = []
                    for k in part:
                        proof = []
                        for level in own:
                            at, k = width * (k % fanout), k // fanout
                            proof.append({"left": level[k][:at], "right": level[k][at + width:]})
                        proofs.append(proof + row["proof"])
                    some = [leaves[k] for k in part]
                    cols = {"grp": [row["grp"]] * len(some), "subroot": [row["subroot"]] * len(some), "root": [row["root"]] * len(some), "proof": proofs}
                    cols |= {c: [x[c] for x in some] for c in ("key", "leaf", "carry")}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in PROVEN], schema=PROVEN)

    return work


def manifest(df: DataFrame, group: str, key: str, fields: Sequence[Column], carry: Column | None = None, fanout: int = 16) -> DataFrame:
    """``grp, key, leaf, carry, subroot, root, proof`` for every row of `df`.

    `fields` are what a leaf hashes, in order; `key` is an integer column.  A proof
    lists, level by level from the leaf to the root, the nodes to the left and to
    the right of the row's own.  `carry` is a string column that goes along.
    """
    scratch = Scratch(df.sparkSession, "merkle")
    name = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))  # null first, and never null
    carried = F.lit(None).cast("string") if carry is None else carry.cast("string")
    leaves = scratch.stage(df.select(name.alias("grp"), F.col(f"`{key}`").cast("long").alias("key"), leaf_hash(*fields).alias("leaf"), carried.alias("carry")), "leaves")
    placed, totals = positions(leaves, ["grp"], [F.col("key").asc_nulls_first(), F.col("leaf")], scratch)
    size = fanout ** LEVELS
    blocks = (placed.withColumn("p", F.floor(F.col("pos") / size).cast("long"))
              .groupBy("grp", "p").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "leaf", "carry"))).alias("rows")))  # `size` rows at most
    totals = totals.select("grp", F.ceil(F.col("total") / size).cast("long").alias("blocks"))
    blocks = scratch.stage(_with_group(blocks, totals, "p").select("grp", "p", "blocks", "rows"), "blocks")
    scratch.drop(leaves)
    nodes = scratch.stage(map_arrow(blocks, _nodes(fanout), "grp string, p long, blocks long, node string"), "nodes")
    inner = scratch.stage(exchange(nodes, fanout, scratch), "inner")

    groups, count = positions(inner.filter("p = 0").select(F.lit("").alias("all"), "grp", F.col("top").alias("subroot")), ["all"], [F.col("grp")], scratch)
    groups = scratch.stage(groups.join(count.withColumnRenamed("total", "groups"), "all"), "groups")
    outer = exchange(groups.select(F.col("all").alias("grp"), F.col("pos").alias("p"), F.col("groups").alias("blocks"), F.col("subroot").alias("node")), fanout, scratch)
    outer = (groups.select("grp", "subroot", F.col("pos").alias("p")).join(outer.drop("grp"), "p")
             .join(totals, "grp").select("grp", "blocks", "subroot", F.col("top").alias("root"), F.col("proof").alias("above")))
    upper = _with_group(inner.select("grp", "p", "proof"), outer, "p").select("grp", "p", "subroot", "root", F.concat("proof", "above").alias("proof"))
    return map_arrow(blocks.join(upper, ["grp", "p"]).select("grp", "blocks", "rows", "subroot", "root", "proof"), _proofs(fanout),
                     f"grp string, key long, leaf string, carry string, subroot string, root string, proof {PROOF}").withColumn("grp", F.expr("case when grp <> '0' then substring(grp, 2) end"))


def _with_group(blocks: DataFrame, of_group: DataFrame, p: str, run: int = 256) -> DataFrame:
    """`blocks` with what ``of_group`` (a row for each ``grp``, with its number of `blocks`) holds.  A large group's row is copied for every `run` of its blocks, so its blocks are spread."""
    copies = of_group.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / run).cast("long"))))
    return blocks.withColumn("_run", F.floor(F.col(p) / run).cast("long")).join(copies, ["grp", "_run"]).drop("_run")


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a proof gives for a leaf."""
    return F.aggregate(proof, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All nodes of a proof, level by level from left to right."""
    return F.array_join(F.transform(proof, lambda at: F.concat(at["left"], at["right"])), "")


def verified(rows: DataFrame, tampered: str = "carry") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest: each proof folded from the leaf in `tampered`, or the own one where that is null."""
    return (rows.withColumn("folded_root", folded(F.col("proof"), F.coalesce(F.col(tampered), F.col("leaf"))))
            .select("key", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
