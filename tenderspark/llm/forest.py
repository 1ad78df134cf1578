"""N-gram Jaccard join by a MinHash LSH forest.

A document's set holds the hashes of every five words in a row (lower-cased,
between white space; fewer words are one shingle).  Equal sets are one class.
Each tree of the forest is a sorted prefix trie: signatures of `DEPTH` minima in
order, where documents next to each other share the longest prefixes.  Matches
are shortened from whole signatures value by value until the recall of pairs at
the threshold reaches the target; all members of a group that hangs together by
matches are compared exactly.

Null and empty texts have no set and no links.  Rows with a null id stay, without
links.  Rows that share an id are one document with the texts of all of them.  An
empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, remembered, slices, texts
from tenderspark.llm.groups import compare_blocks, components, in_blocks, jaccard_links
from tenderspark.llm.sketch import MinHash, windows

WORDS = 5
TREES, DEPTH, SHORTEST = 16, 6, 2
BLOCK = 1 << 19

SIGNED = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("trees", pa.binary())])
SET = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("weight", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])


class _Numbers(dict):
    """64-bit hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _numbers() -> _Numbers:
    return remembered(("numbers",), _Numbers)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_numbers().__getitem__, words), np.uint64, len(words))
    return np.unique(windows(ids, min(WORDS, len(ids))))


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = MinHash(TREES * DEPTH, 9)
    for batch in slices(batches, "text", 1 << 20):
        docs, sets = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(own := shingles(text)):
                docs.append(doc)
                sets.append(own)
        if docs:
            count = np.array([len(s) for s in sets])
            signature = hashes.of(np.concatenate(sets), np.cumsum(count) - count, count)
            yield batch_of(SIGNED, doc_id=docs, cls=[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], n=count,
                           trees=[s.astype(">u4").tobytes() for s in signature])


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the first values, by which rows are dealt, and the whole signature, whose bytes sort as its values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").astype(np.uint64).reshape(-1, DEPTH)
        tree = np.tile(np.arange(TREES, dtype=np.uint64), batch.num_rows)
        key = windows(np.column_stack([tree, data[:, :SHORTEST]]).reshape(-1), SHORTEST + 1)[::SHORTEST + 1].view(np.int64)
        raw = data.astype(">u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([raw[k:k + 4 * DEPTH] for k in range(0, len(raw), 4 * DEPTH)], pa.binary()),
                                          pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], names=["key", "signature", "id"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows next to each other in a trie that share at least the shortest prefix, and how many values they share."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
        if last is not None:
            key, ids, values = np.append(last[0], key), np.append(last[1], ids), np.concatenate([last[2], values])
        last = key[-1:], ids[-1:], values[-1:]
        depth = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1)
        at = np.flatnonzero((key[1:] == key[:-1]) & (depth >= SHORTEST) & (ids[1:] != ids[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[at + 1]), pa.array(depth[at].astype(np.int32))], names=["a", "b", "depth"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        own = [shingles(t) for t in batch.column(0).to_pylist()]
        yield batch_of(SET, id=batch.column(1), grp=batch.column(2), weight=batch.column(3), n=[len(s) for s in own], items=[s.tobytes() for s in own])


def reach(similarity: float, depth: int) -> float:
    """The chance that two sets share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity ** depth) ** TREES


def near_duplicates(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> DataFrame:
    """``doc_id, component_id, n_links, kept`` for every document.

    n_links: other documents of at least the similarity; component_id: the
    smallest id reachable by links; kept: whether that is its own.
    """
    scratch = Scratch(docs.sparkSession, "forest")
    named = texts(docs)
    signed = scratch.stage(map_arrow(named.filter("doc_id is not null"), _sign, "doc_id long, cls binary, n long, trees binary"), "signed")
    classes = signed.groupBy("cls").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("weight"), F.max("n").alias("n"))
    one = signed.groupBy("cls").agg(F.min("doc_id").alias("id"), F.any_value("trees").alias("trees"))
    tries = map_arrow(one.select("id", "trees"), _tries, "key long, signature binary, id long")
    dealt = tries.repartition("key").sortWithinPartitions("key", "signature", "id")
    pairs = map_arrow(dealt, _neighbours, "a long, b long, depth int").groupBy("a", "b").agg(F.max("depth").alias("depth"))
    pairs = scratch.stage(pairs, "pairs")
    classes = scratch.stage(classes, "classes")
    # Prefixes are shortened until a pair that just reaches the threshold is found as surely as asked; other links of the data have no say in it.
    depth = next((d for d in range(DEPTH, SHORTEST, -1) if reach(threshold, d) >= target), SHORTEST)
    groups = components(pairs.filter(F.col("depth") >= depth).select("a", "b"), scratch).withColumnRenamed("component", "grp")
    members = scratch.stage(groups.join(classes.groupBy("id").agg(F.max("weight").alias("weight"), F.sum("n").alias("n")), "id"), "members")
    found = named.join(members.withColumnRenamed("id", "doc_id"), "doc_id").select("text", "doc_id", "grp", "weight")
    sets = map_arrow(found, _sets, "id long, grp long, weight long, n long, items binary").filter("n > 0")
    links = scratch.stage(compare_blocks(in_blocks(sets, "n", BLOCK, members), jaccard_links(threshold)), "links")
    joined = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    counts = links.groupBy("id").agg(F.sum("links").alias("links")).join(joined, "id", "full")
    of_class = scratch.stage(classes.join(counts, "id", "left").select("cls", F.coalesce("component", "id").alias("component"),
                                                                  (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "of-class")
    of_doc = signed.select("doc_id", "cls").join(of_class, "cls").groupBy("doc_id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(of_doc, "doc_id", "left")
            .select("doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept")))


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each component stays: that with the smallest id."""
    gone = near_duplicates(docs.select("doc_id", "text"), threshold).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
