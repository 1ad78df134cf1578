"""Best-fit packing with bound-certified repacking.

Pieces are dealt evenly into partitions and packed best-fit decreasing.  Lower
bounds from dual feasible functions certify the number of bins; while the total
stays above the bound of the whole table, all bins but those of a single full
piece are dealt into groups of bounded size and packed anew, the new bins being
kept only where they are fewer.  A group that meets the bound of its own pieces is
left as it is.  Groups are drawn by chance, from neighbouring partitions, then from
all, until two rounds in a row don't lower the number; then the loosest bins of the
groups meet in ever fewer groups.  Both are done again as long as that helps.

Only lengths and checksums of pieces move; ids stay where they were made.

Null and empty texts are one piece of the end id.  Null ids and repeated rows are
packed like any other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, slices
from tenderspark.llm.tokens import SLICE, crc_of, encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("home", pa.int64()), ("loose", pa.int32())])
PIECED = pa.schema([*PIECE, ("part", pa.int64())])
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SQL = PIECE_SQL + ", sequence_id long, offset long, part long, home long, loose int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: all full, but the first takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, part: Column | None = None) -> DataFrame:
    """The pieces of every whole text with `end_id` after it, and their `part`; only texts longer than `capacity` are cut."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", SLICE):
            rows = []
            for doc, data, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                ids = np.append(np.frombuffer(data, enc.dtype), enc.dtype.type(end_id))
                rows.extend((doc, k, s, n, crc_of(ids[s:s + n]), own) for k, (s, n) in enumerate(cut(len(ids), capacity)))
            yield batch_of(PIECED, **dict(zip(PIECED.names, map(list, zip(*rows)))))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       (F.lit(None) if part is None else part).cast("long").alias("part"))
    return map_arrow(read, work, PIECE_SQL + ", part long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = free >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            open_bins[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, np.array(room, dtype=np.int64)


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that lengths counted by `histogram` need at least, by dual feasible functions.

    Tries the sizes themselves, the rounding functions u(k), and for each
    threshold the function that takes sizes above capacity less threshold as whole
    bins and drops those below the threshold.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = math.ceil(int(histogram @ sizes) / capacity)
    for k in range(1, 33):
        whole = sizes * (k + 1) % capacity == 0
        scaled = np.where(whole, sizes * k, (sizes * (k + 1) // capacity) * capacity)  # times k
        best = max(best, math.ceil(int(histogram @ scaled) / (capacity * k)))
    count, total = np.cumsum(histogram), np.cumsum(histogram * sizes)
    t = np.arange(0, capacity // 2 + 1)
    big = count[-1] - count[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    return max(best, int(np.max(big + -(-middle // capacity))))


def _pack(capacity: int, round_no: int):
    """Packs the rows of a task, one group for each `part`; where they were packed before, keeps the old bins unless the new are fewer.

    `home` is the first partition that a bin has pieces of.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = table["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])).tolist()
        for a, b in zip(bounds, [*bounds[1:], len(order)]):
            rows = table.take(pa.array(order[a:b]))
            length = rows["length"].to_numpy()
            sequence = None
            if round_no:
                old, bins = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
                if lower_bound(np.bincount(length, minlength=capacity + 1), capacity) >= len(old):
                    sequence = old[bins]
            if sequence is None:
                new, offset, room = best_fit(length, capacity)
                if round_no and len(room) >= len(old):
                    sequence = old[bins]
                else:
                    bins, sequence = new, (round_no << 48) + (int(part[order[a]]) << 28) + new
            if round_no and sequence[0] == old[bins[0]]:
                offset = rows["offset"].to_numpy()
                room = capacity - np.bincount(bins, weights=length).astype(np.int64)
            loosest = np.empty(len(room), np.int64)
            loosest[np.argsort(-room, kind="stable")] = np.arange(len(room))
            home = np.full(len(room), np.iinfo(np.int64).max)
            np.minimum.at(home, bins, rows["home"].to_numpy())
            yield batch_of(PLACED, **{n: rows[n].combine_chunks() for n in PIECE.names}, sequence_id=sequence, offset=offset,
                           part=np.full(b - a, part[order[a]]), home=home[bins], loose=np.where(room[bins] > 0, loosest[bins], len(room) + 1))

    return work


def _near(current: DataFrame, span: int, per_part: int, round_no: int) -> tuple[DataFrame, int]:
    """Bins dealt by chance into groups of about `per_part` pieces, among `span` partitions each; and the number of groups."""
    spans = F.floor(F.col("home") / span).cast("long")
    last, most = current.groupBy(spans.alias("s")).count().agg(F.max("s"), F.max("count")).first()
    each = math.ceil(most / per_part)
    return current.withColumn("part", spans * each + F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(each))), (last + 1) * each


def pack(items: DataFrame, capacity: int, scratch: Scratch, per_part: int = 50_000, given_up: int = 64, width: int = 8) -> DataFrame:
    """Adds ``sequence_id, offset`` to `items` (written pieces).

    A task holds about `per_part` pieces, dealt in turn; where pieces have a `part`
    (all or none of them), it holds those of one part, and sequences are numbered
    in the order of the parts, those packed anew after the others.  Of each group, the
    `given_up` loosest bins meet those of `width` groups, after all bins were dealt anew.
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in items.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        histogram[n] = k
    need = lower_bound(histogram, capacity)
    parts = max(1, math.ceil(int(histogram.sum()) / per_part))
    if (given := items.agg(F.max("part")).first()[0]) is not None:
        parts = given + 1
        dealt = items.repartition(parts, "part")
    else:
        dealt = items.repartition(parts).withColumn("part", F.spark_partition_id().cast("long"))  # in turn, so that no id or length makes a large part
    dealt = dealt.select("*", *[F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset")], F.col("part").alias("home"))
    first = scratch.stage(map_arrow(dealt, _pack(capacity, 0), PLACED_SQL), "packed")
    full, current = first.filter(F.col("length") == capacity), first.filter(F.col("length") < capacity)
    need -= int(histogram[capacity])

    def bins_of(table: DataFrame) -> int:
        return table.filter("offset = 0").count()

    bins, span, round_no, groups, last = bins_of(current), 1, 0, parts, math.inf
    while need < bins < last and parts > 1:
        last, idle = bins, 0
        while bins > need and idle < 2:
            round_no += 1
            span = span * width if span < parts else span
            dealt, groups = _near(current, span, per_part, round_no)
            current = scratch.stage(map_arrow(dealt.repartition(groups, "part"), _pack(capacity, round_no), PLACED_SQL), "repacked")
            fewer = bins_of(current)
            idle = 0 if fewer < bins or span < parts else idle + 1
            bins = fewer
        tables = [current]
        while bins > need and groups > 1:
            round_no += 1
            groups = math.ceil(groups / width)
            freed = tables[-1].filter(F.col("loose") < given_up).withColumn("part", F.floor(F.col("part") / width).cast("long"))
            tables[-1] = tables[-1].filter(F.col("loose") >= given_up)
            tables.append(scratch.stage(map_arrow(freed.repartition(groups, "part"), _pack(capacity, round_no), PLACED_SQL), "exchanged"))
            bins = sum(map(bins_of, tables))
        current = tables[0]
        for table in tables[1:]:
            current = current.unionByName(table)
    return full.unionByName(current).select(*PIECE.names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, part: Column | None = None) -> DataFrame:
    """Packs every document into as few sequences of at most `capacity` ids as it can; see `pack` for `part`, the module for odd rows."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.stage(pieces(docs, path, capacity, end_id, part), "pieces"), capacity, scratch)
