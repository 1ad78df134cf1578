"""Token counts by byte-pair merging with a heap and a linked list.

The lowest-rank adjacent pair is popped again and again; the count is the number
of initial symbols less the merges.  No identifiers are given out.

Null and empty texts count 0 tokens.  Null ids stay null; repeated rows are
counted each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tenderspark.llm.common import batch_of, map_arrow, remembered, slices, texts
from tenderspark.llm.tokens import SLICE, Chunks, byte_symbols

# Fixed: the pattern of the byte-level pre-tokenizer.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class MergeCounter(Chunks):
    """Counts tokens by the merges, added tokens and pre-tokens of a byte-level BPE file."""

    def __init__(self, path: str, held: int = 300_000, **limits: int):
        super().__init__(held, **limits)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        numbers = {s: b for b, s in enumerate(byte_symbols())}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = numbers.setdefault(left + right, len(numbers))
            self.merges.setdefault((numbers[left], numbers[right]), (rank, made))
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pattern = regex.compile(PRE_TOKENS)

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left of `symbols` when no pair can be merged."""
        n = len(symbols)
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = made, -1
            k = right[i] = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = left[i]
            if h >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return count

    def count(self, text: str) -> int:
        total = 0
        for part in self.added.split(text) if self.added else [text]:
            if self.added and self.added.fullmatch(part):
                total += 1
            else:
                total += sum(self.merged(list(p.encode())) for p in self.pattern.findall(part))
        return total

    def compute(self, strings: list[str]) -> list[int]:
        return list(map(self.count, strings))

    def spread(self, values: list[int], at: np.ndarray, bounds: np.ndarray) -> list[int]:
        return np.add.reduceat(np.array(values)[at], bounds[:-1]).tolist()


def counter(path: str) -> MergeCounter:
    return remembered(("counter", path), lambda: MergeCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; `path` names a byte-level BPE file of the tokenizers library."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, "text", SLICE):
            strings = batch.column(1).to_pylist()
            n = own.values(strings)
            yield batch_of(COUNTS, doc_id=batch.column(0), n_bytes=[len(s.encode()) for s in strings], n_tokens=n, over_limit=[x > limit for x in n])

    return map_arrow(texts(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
