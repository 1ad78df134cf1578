"""Phrase collocations from count streams kept in prefix and in suffix order.

Every word of a piece gives one record: it and the two words after it, fewer at
the end of the piece.  Sorted, these records are a stream in prefix order whose
runs are the counts of single words, pairs and triples at once.  The frequent
counts are then read twice as sorted streams, by their words from the first and
from the last one: a count's parts stand before it in the same run, so one pass
in lockstep joins left parts and extensions to the right, the other right parts
and extensions to the left.  Nothing is looked up by hash, and streams are dealt
by ranges, so the phrases of a frequent word may lie in many partitions; what a
run needs from an earlier partition are the two counts open at its end.

Words are what stands between spaces and tabs in the pieces of a text; A-Z are
lower-cased.  Null and empty texts have no words, a null language is `und`.
Document ids aren't read: repeated rows count each.  An empty table, or one
without a frequent phrase, gives no rows.  Further columns are not read.  Phrases
of equal score go by count, then by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, slices

LONGEST = 3
END = "\0"  # after the language and after every word of a key; sorts before all else, so runs stay together
SLICE = 16 << 20
_BREAKS = b".,;:!?\n\x0b\x0c\r"

COUNT = pa.schema([("key", pa.string()), ("n", pa.int64())])
RUN = pa.schema([("key", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("open", pa.bool_())])
PART = pa.schema([("key", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("up1", pa.int64()), ("up2", pa.int64()), ("last", pa.bool_())])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[list(_BREAKS)] = 2


def _escape(words: pa.Array) -> pa.Array:
    """`END` inside a word is written otherwise, so that it can end one."""
    return pc.replace_substring(pc.replace_substring(words, "\1", "\1\2"), END, "\1\1")


def _unescape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\1\1"), F.lit(END)), F.lit("\1\2"), F.lit("\1"))


def words_of(strings: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, dictionary-encoded, the text of each, and whether the next word stands in the same piece."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] |= inside[first]
    at = np.flatnonzero(begins)
    text = np.searchsorted(offsets, at, side="right") - 1
    piece = np.cumsum(kind == 2)[at]
    follows = np.append((text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), False)[:len(at)]
    ends = np.append(np.cumsum(inside)[at] - 1, inside.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[raw[inside]]))])
    return words.dictionary_encode(), text, follows


def count_records(langs: pa.Array, strings: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The records of all words of the texts, and how often each occurs."""
    coded, text, follows = words_of(strings)
    lang = langs.dictionary_encode()
    words = pa.concat_arrays([pa.array([""], pa.large_string()), _escape(coded.dictionary)])
    one = coded.indices.to_numpy().astype(np.int64) + 1
    two = np.where(follows, np.append(one[1:], 0), 0)
    three = np.where(two > 0, np.append(two[1:], 0), 0)
    base = len(words)
    heads, head = np.unique(lang.indices.to_numpy().astype(np.int64)[text] * base + one, return_inverse=True)
    tails, tail = np.unique(two * base + three, return_inverse=True)
    found, n = np.unique(head * len(tails) + tail, return_counts=True)
    head, tail = heads[found // len(tails)], tails[found % len(tails)]
    parts = [_escape(lang.dictionary.cast(pa.large_string())).take(pa.array(head // base)), words.take(pa.array(head % base)),
             words.take(pa.array(tail // base)), words.take(pa.array(tail % base)), pa.scalar("", pa.large_string())]
    return pc.binary_join_element_wise(*parts, pa.scalar(END, pa.large_string())), pa.array(n, pa.int64())


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys, n = count_records(table["lang"].combine_chunks(), table["text"].combine_chunks())
        for k in range(0, len(keys), 100_000):
            yield batch_of(COUNT, key=keys.slice(k, 100_000).cast(pa.string()), n=n.slice(k, 100_000))

    for batch in slices(batches, "text", SLICE):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= SLICE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _prefixes(keys: pa.Array) -> list[pa.Array]:
    """The first part of each key, its first two, three, and all four, each with its `END`."""
    raw = keys.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    cuts = np.flatnonzero(data == 0).reshape(len(keys), LONGEST + 1) + 1
    place = np.arange(len(data))
    out = []
    for k in range(LONGEST):
        keep = place < np.repeat(cuts[:, k], np.diff(offsets))
        ends = np.append(0, np.cumsum(cuts[:, k] - offsets[:-1]))
        out.append(pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[keep]))]))
    return [*out, keys.cast(pa.large_string())]


def _runs(least: int):
    """Counts of all prefixes of a sorted stream of records.

    Runs of a language (size 0) and those counted `least` times or more are given
    out.  The first and the last run of a partition may go on in another one:
    these are given out as open.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bool] | None] = [None] * (LONGEST + 1)

        def chosen(keys: pa.Array, size: int, n: np.ndarray, head: bool) -> pa.RecordBatch:
            open_ = np.zeros(len(n), bool)
            open_[:1] = head
            keep = open_ | (n >= (least if size else 0))
            at = pa.array(np.flatnonzero(keep))
            return batch_of(RUN, key=keys.take(at).cast(pa.string()), size=np.full(len(at), size), n=n[keep], open=open_[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column(1).to_numpy()
            for size, names in enumerate(_prefixes(batch.column(0))):
                change = np.append(True, pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False))
                starts = np.flatnonzero(change)
                sums, names = np.add.reduceat(counts, starts), names.take(pa.array(starts))
                head = held[size] is None
                if not head:
                    name, n, head = held[size]
                    if name == names[0].as_py():
                        sums[0] += n
                    else:
                        sums, names = np.append(n, sums), pa.concat_arrays([pa.array([name], names.type), names])
                held[size] = names[-1].as_py(), int(sums[-1]), head and len(names) == 1
                if len(names) > 1:
                    yield chosen(names.slice(0, len(names) - 1), size, sums[:-1], head)
        last = [(name, size, n, True) for size, x in enumerate(held) if x for name, n in [x[:2]]]
        if last:
            yield batch_of(RUN, **dict(zip(RUN.names, map(list, zip(*last)))))

    return work


def _lockstep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each count of a sorted stream with the counts of its first word (`up1`) and first two words (`up2`).

    These stand before it in the stream.  Where they lie in an earlier partition
    they stay null; the ones open at a partition's end are given out as `last`.
    """
    held: list[tuple[str, int] | None] = [None, None]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, size, n = (batch.column(k) for k in range(3))
        size, n = size.to_numpy(), n.to_numpy()
        up = []
        for k in (0, 1):
            own = np.flatnonzero(size == k + 1)
            at = np.maximum.accumulate(np.where(size == k + 1, np.arange(len(size)), -1))
            value = np.where(at >= 0, n[at], held[k][1] if held[k] else -1)
            up.append(pa.array(value, mask=(value < 0) | (size <= k + 1)))
            if len(own):
                held[k] = keys[int(own[-1])].as_py(), int(n[own[-1]])
        yield batch_of(PART, key=keys, size=size, n=n, up1=up[0], up2=up[1], last=np.zeros(len(n), bool))
    last = [(x[0], k + 1, x[1], None, None, True) for k, x in enumerate(held) if x]
    if last:
        yield batch_of(PART, **dict(zip(PART.names, map(list, zip(*last)))))


def _words(key: Column) -> Column:
    parts = F.split(key, END)
    return F.slice(parts, 2, F.size(parts) - 2)


def _first(key: Column, words: int) -> Column:
    """The key of the language and the first `words` words."""
    return F.concat(F.substring_index(key, END, words + 1), F.lit(END))


def _reversed(key: Column) -> Column:
    return F.concat(F.substring_index(key, END, 1), F.lit(END), F.array_join(F.reverse(_words(key)), END), F.lit(END))


def sorted_stream(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("key").sortWithinPartitions("key")


def with_parts(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, size, n, up1, up2`` of all counts: the stream in the order of its keys, read in lockstep with itself."""
    found = scratch.stage(map_arrow(sorted_stream(counts.select("key", "size", "n")), _lockstep, "key string, size int, n long, up1 long, up2 long, last boolean"), "parts")
    rows = found.filter("not last").drop("last")
    lost = (F.col("up1").isNull() & (F.col("size") > 1)) | (F.col("up2").isNull() & (F.col("size") > 2))
    # Two rows a partition at most, whatever the data.
    ends = found.filter("last").groupBy("key").agg(F.max("n").alias("m"))
    one, two = F.broadcast(ends.toDF("_k1", "_m1")), F.broadcast(ends.toDF("_k2", "_m2"))
    mended = (rows.filter(lost).join(one, (_first(F.col("key"), 1) == F.col("_k1")), "left")
              .join(two, (F.col("size") > 2) & (_first(F.col("key"), 2) == F.col("_k2")), "left")
              .select("key", "size", "n", F.coalesce("up1", "_m1").alias("up1"), F.coalesce("up2", "_m2").alias("up2")))
    return rows.filter(~lost).unionByName(mended)


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``key, size, n``: occurrences of every word, pair and triple found `least` times or more, and (size 0) of all words of a language."""
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    records = scratch.stage(map_arrow(named, _records, "key string, n long"), "records")
    runs = scratch.stage(map_arrow(sorted_stream(records), _runs(least), "key string, size int, n long, open boolean"), "runs")
    scratch.drop(records)
    # Eight open rows a partition at most.
    spanning = runs.filter("open").groupBy("key", "size").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= least))
    counts = runs.filter("not open").drop("open").unionByName(spanning)
    # A record that ends early has no second or third word: its key ends in nothing but ends.
    return scratch.stage(counts.filter((F.col("size") == 0) | ~F.col("key").endswith(END + END)), "counts")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the `top` phrases of two and three words of each language.

    A phrase's score is that of its weakest cut.  A pair goes when a frequent
    triple that holds it makes up half of its occurrences or more.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = phrase_counts(docs, least, scratch)
    stream = counts.filter("size > 0")
    left = with_parts(stream, scratch)
    right = with_parts(stream.withColumn("key", _reversed(F.col("key"))), scratch)
    none = F.lit(None).cast("long")
    covers = (F.col("size") == 3) & (2 * F.col("n") >= F.col("up2"))
    by_phrase = (left.filter("size > 1").select("key", "n", F.col("up1").alias("l1"), F.col("up2").alias("l2"), none.alias("r1"), none.alias("r2"), F.lit(False).alias("held"))
                 .union(right.filter("size > 1").select(_reversed(F.col("key")), "n", none, none, "up1", "up2", F.lit(False)))
                 .union(left.filter(covers).select(_first(F.col("key"), 2), none, none, none, none, none, F.lit(True)))
                 .union(right.filter(covers).select(_reversed(_first(F.col("key"), 2)), none, none, none, none, none, F.lit(True)))
                 .groupBy("key").agg(*[F.max(c).alias(c) for c in ("n", "l1", "l2", "r1", "r2", "held")]).filter("not held"))
    a = F.col("n")
    first = F.struct(score(a, F.col("l1"), F.coalesce("r2", "r1")).alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.coalesce("r2", "r1").alias("r"))
    second = F.when(F.col("l2").isNotNull(), F.struct(score(a, F.col("l2"), F.col("r1")).alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r1").alias("r")))
    cut = F.least(first, F.coalesce(second, first))
    scored = by_phrase.select(F.substring_index("key", END, 1).alias("lang"), _unescape(F.array_join(_words(F.col("key")), " ")).alias("phrase"), a.alias("a"), cut.alias("cut"))
    # A language may hold most phrases: the best of its parts first.
    order = (F.desc("cut.score"), F.desc("a"), "phrase")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for keys in (["lang", "_part"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = scored
    totals = counts.filter("size = 0").select(F.substring_index("key", END, 1).alias("lang"), F.col("n"))
    return ranked.join(totals, "lang").select(_unescape(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                              F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
