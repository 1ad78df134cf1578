"""Quality classifier: supervised subword embeddings, averaged per document.

A document's features are its words, the character n-grams of each word (with
its ends marked), and a back-reference symbol wherever a word repeats the one
before (a long symbol, so that it weighs as much as the word).  Each is hashed to a row of learned vectors; the average over all of a
text's features goes through a softmax.  Vectors and output are trained by numpy
stochastic gradient descent with steps scaled per row.

Because the output is linear in the average, a word adds a fixed amount to the
logit; whole texts are scored by summing those amounts.

Null and empty texts get the score of the bias alone.  Rows with a null id are
scored; repeated rows each.  Labels that are null are not learned from, and a
document with contradicting labels counts as good where at least half say so.
An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import Scratch, batch_of, map_arrow, remembered, slices, texts
from tenderspark.llm.sketch import windows

BUCKETS = 1 << 18
SHORTEST, LONGEST = 3, 5
REPEAT = "\0the word before is repeated"
FOLDS = 5

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("rows", pa.binary()), ("shares", pa.binary())])


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words and of their character n-grams, and the number of the word that each belongs to."""
    marked = [f"<{w}>" for w in words]
    symbols = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array(list(map(len, marked)))
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(symbols))  # symbols up to the word's end
    hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, marked), np.uint64, len(marked))]
    owners = [np.arange(len(words))]
    for n in range(SHORTEST, min(LONGEST, len(symbols)) + 1):
        whole = np.flatnonzero(left[:len(symbols) - n + 1] >= n)
        hashes.append(windows(symbols, n)[whole])
        owners.append(owner[whole])
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def _words(text: str) -> tuple[list[str], int]:
    words = text.split()
    return words, sum(map(eq, words, words[1:]))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and the share each has among its features."""
    words, repeats = _words(text)
    counts = Counter(words)
    if repeats:
        counts[REPEAT] += repeats
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    rows, owner = rows_of(list(counts))
    found, at = np.unique(rows, return_inverse=True)
    total = np.bincount(at, weights=np.array(list(counts.values()))[owner])
    return found.astype(np.int32), (total / total.sum()).astype(np.float32)


@dataclass
class Model:
    """What each row adds to the logit of class 1, and the bias."""

    amount: np.ndarray
    bias: float

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 6, rate: float = 0.3, seed: int = 8) -> Model:
    """Stochastic gradient descent over one document at a time; the step of each row shrinks with the squares of its gradients."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    spread = np.full(BUCKETS, 1e-6, np.float32)
    out, bias = rng.normal(0, 0.1, (2, dim)), np.zeros(2)
    out_spread, bias_spread = np.full((2, dim), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            rows, shares, label = samples[k]
            own = vectors[rows]
            mean = shares @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            if len(rows):
                step = np.outer(shares, p @ out).astype(np.float32)
                spread[rows] += (step * step).sum(1)
                vectors[rows] = own - rate * step / np.sqrt(spread[rows])[:, None]
            step = np.outer(p, mean)
            out_spread += step * step
            out -= rate * step / np.sqrt(out_spread)
            bias_spread += p * p
            bias -= rate * p / np.sqrt(bias_spread)
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc: int | None) -> bool:
    """Every fifth document by the checksum of its id's text is never learned from."""
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Features of at most `most` labelled documents outside the held-out fold, picked by a hash of their ids."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield batch_of(FEATURES, doc_id=batch.column(0), quality=batch.column(2), rows=[r.tobytes() for r, _ in made], shares=[s.tobytes() for _, s in made])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")  # at most `most` pairs of numbers
    return map_arrow(joined, work, "doc_id long, quality int, rows binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500) -> Model:
    """Trains on a sample of `most` labelled rows at most, which is all that the driver sees; where rows repeat an id, on the first of them."""
    scratch = Scratch(docs.sparkSession, "quality")
    first = F.min_by(F.struct("quality", "rows", "shares"), F.struct("rows", "shares")).alias("r")
    rows = scratch.stage(training_rows(docs, labels, most).groupBy("doc_id").agg(first), "training")
    samples = [(r["doc_id"], r["r"]) for r in rows.toLocalIterator()]
    scratch.drop(rows)
    return train([(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["shares"], np.float32), r["quality"]) for _, r in sorted(samples, key=lambda x: x[0])])


class Scorer:
    """Scores texts; remembers what a bounded number of words add (real part) and their features (imaginary part)."""

    def __init__(self, model: Model, held: int = 100_000):
        self.model = model
        self.held = held
        self.known: dict[str, complex] = {}

    def scores(self, texts: list[str]) -> list[float]:
        split = [_words(t) for t in texts]
        wanted = {REPEAT}.union(*[words for words, _ in split])
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > self.held:
            self.known.clear()
            new = wanted
        if new:
            rows, owner = rows_of(words := list(new))
            value = np.bincount(owner, weights=self.model.amount[rows], minlength=len(words)) + 1j * np.bincount(owner, minlength=len(words))
            self.known.update(zip(words, value.tolist()))
        amount, out = self.known.__getitem__, []
        for words, repeats in split:
            total = sum(map(amount, words), 0j) + repeats * amount(REPEAT)
            out.append(self.model.score(self.model.bias + (total.real / total.imag if words else 0.0)))
        for w in [w for w in new if len(w) > 100]:
            del self.known[w]
        return out


def _scorer(amount: bytes, bias: float) -> Scorer:
    return remembered(("scorer", xxhash.xxh3_128_digest(amount), bias), lambda: Scorer(Model(np.frombuffer(amount, np.float64), bias)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.amount.tobytes(), model.bias))  # BUCKETS numbers

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(*shared.value)
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            scores = own.scores(batch.column(1).to_pylist())
            yield batch_of(SCORED, doc_id=ids, held_out=[held_out(d) for d in ids], score=scores, predicted=[int(s >= threshold) for s in scores])

    return map_arrow(texts(docs), work, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the model accepts, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.amount.tobytes(), model.bias))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(*shared.value)
        for batch in slices(batches, "text"):
            strings = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array([s >= threshold for s in own.scores(strings)]))

    return map_arrow(docs, work, docs.schema)
