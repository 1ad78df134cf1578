"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines are the parts of a text between line feeds; they are compared lower-cased
and with runs of white space as one space.  Lines that are equal so are one class.
Classes meet where a band of their signatures is equal; in a group that hangs
together by such bands all exact links count (Jaccard of the lines' sets of
`SHINGLE` characters, a shorter line being one shingle).  Of each component of
links the line that comes first by document id and line number is kept.

Blank lines stay.  Null and empty texts have no lines.  Rows with a null id keep
all their lines and take no part.  Rows that share an id are one document: a line
goes from all of them or from none.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, runs, slices, texts
from tenderspark.llm.groups import components, in_blocks, jaccard_span, span_blocks
from tenderspark.llm.sketch import MinHash, windows

SHINGLE = 8
BANDS, ROWS = 10, 4
BLOCK = 1 << 20
MEMBERS = 4096
PART = 1 << 19
ENTRIES = 1 << 20  # bands of a task

LINE = pa.schema([("line", pa.binary()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("bands", pa.binary())])
MEMBER = pa.schema([("id", pa.binary()), ("grp", pa.int64()), ("n", pa.int64()), ("text", pa.string())])


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def _key(line: str) -> bytes:
    """128 bits, so that no two of even 10^12 different lines can be expected to share theirs."""
    return xxhash.xxh3_128_digest(line)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, and where each line's begin and how many they are."""
    padded = [s.ljust(SHINGLE, "\0") for s in lines]
    symbols = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(s) for s in padded])
    return windows(symbols, SHINGLE), np.cumsum(length) - length, length - SHINGLE + 1


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    """All lines that aren't blank, with their documents and numbers."""
    for batch in slices(batches, "text", 1 << 20):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, line in enumerate(text.split("\n")):
                if found := plain(line):
                    yield doc, k, found


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and bands of lines, `PART` characters at a time: a text may be longer than any slice."""
    hashes = MinHash(BANDS * ROWS, 4)
    held: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        docs, numbers, lines = map(list, zip(*held))
        signature = hashes.of(*_shingles(lines)).astype(np.uint64).reshape(len(lines), BANDS, ROWS)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :, None], (len(lines), BANDS, 1))
        data = windows(np.concatenate([band, signature], axis=2).reshape(-1), ROWS + 1)[::ROWS + 1].tobytes()
        width = BANDS * 8
        return batch_of(LINE, line=[_key(s) for s in lines], doc_id=docs, line_no=numbers,
                        bands=[data[k:k + width] for k in range(0, len(data), width)])

    for row in _numbered(batches):
        held.append(row)
        size += max(len(row[2]), SHINGLE)
        if size >= PART:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _deal_bands(parts: int):
    """The bands of lines and the lines' short keys as pairs of 64-bit values, those of a part in one row for each `PART` bands; of equal lines there once."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            line, at = np.unique(np.concatenate([x.column(0).to_numpy() for x in held]), return_index=True)
            keys = np.frombuffer(b"".join(b for x in held for b in x.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)[at]
            pairs = np.stack([keys.reshape(-1), np.repeat(line.view(np.uint64), BANDS)], axis=1)
            part = (pairs[:, 0] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            some, start = np.unique(part[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in np.split(pairs[order], start[1:])], pa.binary())], names=["part", "pairs"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) * BANDS >= PART:
                yield flush()
                held = []
        if any(x.num_rows for x in held):
            yield flush()

    return work


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines that share a band each with the next."""
    for table in runs(batches, ("part",)):
        pairs = np.frombuffer(b"".join(table["pairs"].to_pylist()), np.uint64).reshape(-1, 2)
        at = np.lexsort((pairs[:, 1], pairs[:, 0]))
        key, line = pairs[at, 0], pairs[at, 1].view(np.int64)
        next_ = np.flatnonzero((key[1:] == key[:-1]) & (line[1:] != line[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(line[next_]), pa.array(line[next_ + 1])], names=["a", "b"])


def _sets(table: pa.Table) -> list[np.ndarray]:
    hashes, start, count = _shingles(table["text"].to_pylist())
    return [np.unique(hashes[a:a + n]) for a, n in zip(start.tolist(), count.tolist())]


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for w in wanted:
                found = lines[w["line_no"]] if w["line_no"] < len(lines) else ""
                if _key(found := plain(found)) == w["line"]:  # else the id is shared and the line is another row's
                    rows.append((w["line"], w["grp"], len(found), found))
        if rows:
            yield batch_of(MEMBER, **dict(zip(MEMBER.names, map(list, zip(*rows)))))


def removed_lines(docs: DataFrame, threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, removed``: the numbers (from 0) of the lines to take out, for documents that lose any."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    named = texts(docs).filter("doc_id is not null")
    lines = scratch.stage(map_arrow(named, _sign, "line binary, doc_id long, line_no int, bands binary"), "lines")
    place = F.struct("doc_id", "line_no")
    distinct = scratch.stage(lines.groupBy("line").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")), "distinct")
    # Bands are the most rows by far: 16 bytes each, and sorted in whole parts.  Lines whose short keys are the same by chance are one candidate more.
    short = F.xxhash64("line")
    parts = max(1, math.ceil(lines.count() * BANDS / ENTRIES))
    dealt = map_arrow(lines.select(short, "bands"), _deal_bands(parts), "part int, pairs binary").repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    groups = components(map_arrow(dealt, _chain, "a long, b long"), scratch).toDF("short", "grp")
    wanted = distinct.select("line", "at", short.alias("short")).join(groups, "short").groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("at.line_no", "line", "grp")).alias("wanted"))
    # Texts of lines are shuffled, not their sets, which are larger.
    members = map_arrow(named.join(wanted, "doc_id").select("text", "wanted"), _lines, "id binary, grp long, n long, text string")
    links = scratch.stage(span_blocks(in_blocks(scratch.stage(members, "members"), "n", BLOCK, most=MEMBERS), lambda table: jaccard_span(_sets(table), threshold)), "links")
    linked = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("id", "line")
    # What may be repeated, line by line: where its component comes first.
    known = scratch.stage(distinct.select("line", "at", "n").join(linked, "line", "left").filter("component is not null or n > 1"), "known")
    first = known.filter("component is not null").groupBy("component").agg(F.min("at").alias("first"))
    first = (known.filter("component is not null").select("line", "component").join(first, "component").select("line", "first")
             .unionByName(known.filter("component is null").select("line", F.col("at").alias("first"))))
    return (lines.select("line", "doc_id", "line_no").join(first, "line").filter(place != F.col("first"))
            .groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, drop_emptied: bool = True) -> DataFrame:
    """`docs` with the repeated lines taken out of ``text``; with `drop_emptied` documents whose every line went go as well."""
    gone = removed_lines(docs, threshold).withColumnRenamed("doc_id", "_doc").withColumnRenamed("removed", "_removed")

    @F.pandas_udf("struct<text:string,left:boolean>")
    def rest(text, removed):
        import pandas as pd

        out, left = [], []
        for t, r in zip(text, removed):
            if r is None:
                out.append(t)
                left.append(True)
                continue
            r = set(r.tolist() if hasattr(r, "tolist") else r)
            kept = [s for k, s in enumerate(t.split("\n")) if k not in r]
            out.append("\n".join(kept))
            left.append(any(s.strip() for s in kept))
        return pd.DataFrame({"text": out, "left": left})

    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("_doc"), "left").withColumn("_rest", rest("text", "_removed"))
    if drop_emptied:
        joined = joined.filter("_rest.left")
    return joined.select(*[F.col("_rest.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
