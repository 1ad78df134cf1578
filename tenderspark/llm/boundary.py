"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands next to each other in no token of the vocabulary can
never be joined by merges.  Wherever such a pair occurs inside a pre-token the
text is cut; the fragments are encoded independently, each distinct one once, and
their ids are put together.  The last fragment of a pre-token alone carries the
vocabulary's word end.  Normalizer and pre-tokenizer are the ones of the file.

Null and empty texts have no ids.  Null document ids stay null, repeated rows are
encoded each, an empty table gives no rows, and further columns are not read.
Texts of any length are encoded whole.  Special strings inside a text are their
own ids, as the library's default is.  In decoding a null list of ids gives an
empty text.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tenderspark.llm.common import map_arrow, remembered, slices, texts
from tenderspark.llm.tokens import SLICE, byte_symbols

# Fixed: the split pattern of word-level vocabularies, and what it comes to for lower-cased ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")

IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Encoder:
    """Ids of texts by a BPE file of the tokenizers library whose pre-tokenizer drops white space.

    `held` bounds how many words and how many fragments are remembered; words
    longer than `longest` never are.
    """

    def __init__(self, path: str, held: int = 300_000, longest: int = 200):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.held, self.longest = held, longest
        self.library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        if [s for s, _ in self.pre_tokenizer.pre_tokenize_str("a \t\n\x0b\x0c\rb")] != ["a", "b"]:
            raise ValueError("texts are cut at white space, which this pre-tokenizer keeps")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.last = self.library.model.tokenize  # puts the word end on the last symbol
        self.inner = BPE(self.vocab, [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]).tokenize
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())):
            raise ValueError("special strings are looked for in the text as it is")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
        self.inside = pairs_inside(self.vocab, self.end)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = [x.get("pattern", {}).get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", ())]
        self.ascii = kinds == ["NFC", "Replace", "Lowercase"] and splits == [PATTERN, None]
        self.symbols = dict(enumerate(byte_symbols()))
        self.words: dict[str, bytes] = {"": b""}
        self.fragments: dict[tuple[str, bool], list[int]] = {}

    def cut(self, symbols: str) -> list[str]:
        """A pre-token, in the symbols of its bytes, cut at every pair that occurs inside no token."""
        begin, out, inside = 0, [], self.inside
        if inside.issuperset(map(operator.add, symbols, symbols[1:])):
            return [symbols]
        for k in range(1, len(symbols)):
            if symbols[k - 1:k + 1] not in inside:
                out.append(symbols[begin:k])
                begin = k
        out.append(symbols[begin:])
        return out

    def fragment(self, symbols: str, last: bool) -> list[int]:
        """Ids of a fragment; `last`: it ends its pre-token."""
        if (known := self.fragments.get((symbols, last))) is not None:
            return known
        ids = [t.id for t in (self.last if last else self.inner)(symbols)]
        if len(symbols) <= self.longest:
            if len(self.fragments) >= self.held:
                self.fragments.clear()
            self.fragments[symbols, last] = ids
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        """In the symbols of their bytes.  Normalized and split by the library, ASCII words by the same rules without a call for each."""
        if self.ascii and text.isascii():
            found = ASCII_PATTERN.findall(text.lower())
            return found if text.isprintable() else [x.translate(self.symbols) for x in found]
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [x for x, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def word(self, word: str) -> bytes:
        """Ids (int32) of a stretch of text without ASCII white space."""
        out: list[int] = []
        for part in self.split_special(word) if self.special else [word]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for symbols in self.pre_tokens(part):
                *pieces, end = self.cut(symbols)
                for piece in pieces:
                    out += self.fragment(piece, False)
                out += self.fragment(end, True)
        return array("i", out).tobytes()

    def encode(self, strings: pa.Array) -> pa.LargeListArray:
        """A list of ids for each text.  Words repeat, so each distinct one of the slice is looked up once."""
        split = pc.ascii_split_whitespace(strings.cast(pa.large_string()))
        coded = split.values.dictionary_encode()
        known, distinct = self.words, coded.dictionary.to_pylist()
        values = list(map(known.get, distinct))
        for k in [k for k, v in enumerate(values) if v is None]:
            values[k] = self.word(distinct[k])
            if len(distinct[k]) <= self.longest:
                if len(known) >= self.held:
                    known.clear()
                    known[""] = b""
                known[distinct[k]] = values[k]
        ends = np.append(0, np.cumsum([len(v) // 4 for v in values]))
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(values), np.int32)))
        lists = lists.take(coded.indices.cast(pa.int64()))
        bounds = lists.offsets.to_numpy()[split.offsets.to_numpy()]
        return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), lists.values)


def pairs_inside(vocab: Iterable[str], end: str) -> set[str]:
    """All pairs of symbols that stand next to each other in some token; every other pair marks a certain cut."""
    found = set()
    for token in vocab:
        symbols = token.removesuffix(end) if end else token
        found.update(symbols[k:k + 2] for k in range(len(symbols) - 1))
    return found


class Decoder:
    """Texts of ids as the library's decode without skipping special ids gives them: for files without a decoder, tokens joined by a space; for byte-level ones, their bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind}")
        self.byte_level = kind == "ByteLevel"
        names = {i: s for s, i in spec["model"]["vocab"].items()}
        if self.byte_level:
            byte = {s: b for b, s in enumerate(byte_symbols())}
            data = {i: bytes(map(byte.__getitem__, s)) for i, s in names.items()}
        else:
            data = {i: s.encode() for i, s in names.items()}
        data |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        self.after = b"" if self.byte_level else b" "
        self.tokens = pa.array([data.get(i, b"") + self.after for i in range(max(data) + 1)], pa.large_binary())

    def decode(self, ids: pa.Array) -> list[str]:
        """`ids`: lists of integers."""
        ids = ids.cast(pa.large_list(pa.int32()))
        parts = self.tokens.take(ids.flatten())
        bounds = np.append(0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)))
        _, offsets, data = parts.buffers()
        cuts = np.frombuffer(offsets, np.int64)[bounds].tolist() if len(parts) else [0] * len(bounds)
        data, less = data.to_pybytes() if data else b"", len(self.after)
        return [data[a:max(a, b - less)].decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)]


def encoder(path: str) -> Encoder:
    return remembered(("boundary", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text; `path` names a BPE file of the tokenizers library."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "text", SLICE):
            ids = own.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids), ids.cast(IDS.field("ids").type)], schema=IDS)

    return map_arrow(texts(docs), work, "doc_id long, n_tokens long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """`coded` (with ``ids``, lists of integers) and the ``decoded`` text of each row."""
    decoded = pa.field("decoded", pa.string())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(path)
        for batch in batches:
            text = pa.array(own.decode(batch.column(batch.schema.get_field_index("ids"))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], schema=batch.schema.append(decoded))

    return map_arrow(coded, work, StructType([*coded.schema.fields, StructField("decoded", StringType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: of the decimal ids joined by a space, and of the decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
