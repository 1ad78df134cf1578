"""Token ids in a compressed format: canonical Huffman codes of limited length, in blocks with checkpoints.

A store is three tables.  ``code``: id and code length of every id that occurs,
from which the canonical codes follow.  ``blocks``: folders ``bucket=n``, whose
order is that of the documents; a block holds whole documents of about
`BLOCK_IDS` ids (a longer document is a block of its own) with their ids,
lengths, the number of ids before the block, the bit stream (each document from
a byte on), and the bit offset of every `STEP`-th id of a document, so that a
block is decoded by itself and from any checkpoint.  The ids are counted over the whole table before any is coded.

Null and empty texts are the end id alone.  Documents are ordered by id, null ids
first; rows that repeat an id stay next to each other.  An empty table makes an
empty store.  Further columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, slices, texts
from tenderspark.llm.tokens import SLICE, encoder

LONGEST = 16
STEP = 256
BLOCK_IDS = 1 << 20
BUCKETS = 1 << 14  # at most: the driver holds a bound and a number for each

CODED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
BITS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("marks", pa.binary())])
BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("stream", pa.binary())])
BLOCK_SQL = "bucket int, block int, first long, doc_ids array<bigint>, lengths array<bigint>, checkpoints binary, stream binary"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `longest` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaves, packages = [], np.empty(0)
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        at = np.argsort(merged, kind="stable")
        leaves.append(np.cumsum(at < n))
        merged = merged[at]
        packages = merged[0:len(merged) - 1:2] + merged[1::2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for held in reversed(leaves):
        if take == 0:
            break
        k = int(held[take - 1])
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: ids by length, then by number."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, longest: int = LONGEST):
        self.longest = longest
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        room = np.int64(1) << (longest - lengths)
        starts = np.cumsum(room) - room  # the codes, moved up to `longest` bits
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.code[ids] = starts >> (longest - lengths)
        self.length[ids] = lengths
        self.symbol = np.zeros(1 << longest, np.uint32)
        self.bits = np.ones(1 << longest, np.uint8)
        used = int(room.sum())
        self.symbol[:used] = np.repeat(ids, room)
        self.bits[:used] = np.repeat(lengths, room)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Codes documents, given one after the other with their `lengths` (1 at least).

        Each begins with a byte of its own.  Returns the stream, the byte at which
        each document begins (and the end), and the bit, counted from the
        document's beginning, of every `STEP`-th of its ids.
        """
        length = self.length[ids].astype(np.int64)
        ends = np.cumsum(length)
        first = np.cumsum(lengths) - lengths
        before = (ends - length)[first]
        sizes = (np.append(before[1:], ends[-1]) - before + 7) // 8
        begins = np.append(0, np.cumsum(sizes))
        inside = ends - length - np.repeat(before, lengths)
        at = inside + np.repeat(begins[:-1] * 8, lengths)
        value = self.code[ids].astype(np.int64) << (24 - length - (at & 7))  # within three bytes
        byte, total = at >> 3, int(begins[-1])
        out = np.zeros(total + 3, dtype=np.float64)
        for k in range(3):  # codes share a byte but no bit, so sums are unions
            out += np.bincount(byte + k, weights=value >> (16 - 8 * k) & 255, minlength=total + 3)
        place = np.arange(len(ids)) - np.repeat(first, lengths)
        return out.astype(np.uint8)[:total].tobytes(), begins, inside[place % STEP == 0]

    def decode(self, stream: bytes, checkpoints: np.ndarray) -> np.ndarray:
        """`STEP` ids from each bit of `checkpoints` on: all stretches at once, an id of each in turn."""
        data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
        window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = checkpoints.astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        top, mask, last = 24 - self.longest, np.uint32((1 << self.longest) - 1), len(window) - 1
        for k in range(STEP):
            peek = window[np.minimum(at >> 3, last)] >> (top - (at & 7)).astype(np.uint32) & mask
            out[k] = self.symbol[peek]
            at += self.bits[peek]
        return np.ascontiguousarray(out.T)


def _tokenize(path: str, end_id: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches, "text", SLICE):
            ids = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            yield batch_of(CODED, doc_id=batch.column(0), n=[len(x) // enc.dtype.itemsize for x in ids], ids=ids)

    return work


def _count(dtype: np.dtype):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            seen = np.pad(seen, (0, max(0, len(own) - len(seen)))) + np.pad(own, (0, max(0, len(seen) - len(own))))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["id", "n"])

    return work


def _sums(bounds: list[int]):
    """Ids in each bucket."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            np.add.at(own, _bucket(batch.column(0).to_pylist(), bounds), batch.column(1).to_numpy())
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(own[used])], names=["bucket", "n"])

    return work


def _encode(code: Code, dtype: np.dtype, bounds: list[int]):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1 << 20):
            docs, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            stream, begins, marks = code.encode(np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype), n)
            own = np.append(0, np.cumsum((n + STEP - 1) // STEP)).tolist()
            yield batch_of(BITS, bucket=_bucket(docs, bounds), doc_id=docs, n=n, bits=[stream[a:b] for a, b in itertools.pairwise(begins.tolist())],
                           marks=[marks[a:b].astype("<u8").tobytes() for a, b in itertools.pairwise(own)])

    return work


def _bucket(docs: list[int | None], bounds: list[int]) -> list[int]:
    return np.searchsorted(np.array(bounds, dtype=np.int64), np.array([-1 << 63 if d is None else d for d in docs], dtype=np.int64), side="right").tolist()


def _blocks(before: dict[int, int]):
    """Joins the documents' streams, in order, to blocks."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, ids, block, first = None, [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, block, first
            bits = 8 * (np.cumsum([len(x) for _, _, x, _ in held]) - [len(x) for _, _, x, _ in held])
            marks = [np.frombuffer(m, "<u8") + np.uint64(b) for (_, _, _, m), b in zip(held, bits.tolist())]
            out = batch_of(BLOCK, bucket=[last], block=[block], first=[first], doc_ids=[[d for d, _, _, _ in held]],
                           lengths=[[n for _, n, _, _ in held]], checkpoints=[np.concatenate(marks).astype("<u8").tobytes()],
                           stream=[b"".join([x for _, _, x, _ in held])])
            held, block, first, ids = [], block + 1, first + ids, 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "doc_id", "n", "bits", "marks"))):
                if held and (row[0] != last or ids >= BLOCK_IDS):
                    yield flush()
                if row[0] != last:
                    last, block, first = row[0], 0, before[row[0]]
                held.append(row[1:])
                ids += row[2]
        if held:
            yield flush()

    return work


def write_ids(docs: DataFrame, path: str, end_id: int = 0, per_bucket: int = 1 << 24) -> str:
    """Writes the ids of every whole text, `end_id` after each, in ascending id order; returns the store's folder.

    Texts are encoded once and kept until the codes are known.  Documents are then
    coded where they lie, so only compressed bits are shuffled; buckets are ranges
    of document ids of about `per_bucket` ids each, more where there would be over
    `BUCKETS` of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    enc = encoder(path)
    coded = scratch.stage(map_arrow(texts(docs), _tokenize(path, end_id), "doc_id long, n long, ids binary"), "coded")
    counted = map_arrow(coded.select("ids"), _count(enc.dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    ids = counted["id"].to_numpy(np.int64)
    lengths = code_lengths(counted["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths)], "id long, length int").coalesce(1).write.parquet(f"{scratch.root}/code")
    code = Code(ids, lengths)
    buckets = min(BUCKETS, max(1, -(-int(counted["n"].sum()) // per_bucket)))
    cuts = coded.stat.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.05 / buckets) if buckets > 1 else []
    bounds = sorted({int(x) for x in cuts})
    totals = map_arrow(coded.select("doc_id", "n"), _sums(bounds), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    before = dict(zip([r[0] for r in totals], itertools.accumulate([0, *[r[1] for r in totals]])))
    bits = map_arrow(coded.select("doc_id", "n", "ids"), _encode(code, enc.dtype, bounds), "bucket int, doc_id long, n long, bits binary, marks binary")
    # A task for each bucket: numbers as they are, as hashes of few numbers collide.
    dealt = bits.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "bits")
    blocks = map_arrow(dealt, _blocks(before), BLOCK_SQL)
    blocks.write.option("compression", "none").partitionBy("bucket").parquet(f"{scratch.root}/blocks")
    scratch.drop(coded)
    return scratch.root


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from a store: every block decoded, its documents' ids summed up."""
    listed = spark.read.parquet(f"{store}/code").toPandas()
    code = Code(listed["id"].to_numpy(np.int64), listed["length"].to_numpy(np.int64))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, lengths, marks, stream in zip(*(batch.column(i).to_pylist() for i in range(5))):
                stretches = code.decode(stream, np.frombuffer(marks, "<u8"))
                own = np.cumsum([0, *[-(-n // STEP) for n in lengths]]).tolist()
                sums = [zlib.crc32(stretches[a:b].reshape(-1)[:n].astype("<u4").tobytes()) for n, (a, b) in zip(lengths, itertools.pairwise(own))]
                yield batch_of(READ, doc_id=docs, start=first + np.cumsum([0, *lengths[:-1]]), n_tokens=lengths, ids_crc32=sums)

    blocks = spark.read.schema(BLOCK_SQL).parquet(f"{store}/blocks").select("first", "doc_ids", "lengths", "checkpoints", "stream")
    return map_arrow(blocks, work, "doc_id long, start long, n_tokens long, ids_crc32 long")
