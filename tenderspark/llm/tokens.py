"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once."""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tenderspark.llm.common import remembered

# A place where a token of a byte-level vocabulary surely ends: before a space that a non-space follows.
_CHUNKS = re.compile(r"(?= \S)")
# What may follow a word without sharing a token with it; an apostrophe may begin a contraction.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

SLICE = 8 << 20  # bytes of text worked on at a time: the more, the fewer words are looked up again


def _word(piece: str) -> tuple[str, str] | None:
    """The letters of a piece and the punctuation after them, if it is nothing else."""
    core = piece.rstrip(_TAIL)
    return (core, piece[len(core):]) if core.isalpha() else None


def _after(pieces: pa.Array, cores: pa.Array) -> pa.Array:
    """What stands after its core in each piece, which begins with it."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int64)[pieces.offset:pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.empty(0, np.uint8)
    size = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.diff(offsets)
    keep = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length) >= np.repeat(size, length)
    ends = np.append(0, np.cumsum(length - size))
    return pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[keep]))])


class Chunks:
    """Values of whole texts from the values of their chunks, each distinct chunk worked out once.

    The pre-tokenizer of byte-level vocabularies never joins what stands before a
    space with the space when a non-space follows, so a text falls into chunks (a
    space and the run after it) whose tokens don't depend on each other.  Within a
    chunk the same holds for a word, the punctuation after it and a line feed
    between two words.  `held` bounds how many words are remembered: of two
    generations the older one goes when the younger is full.
    """

    def __init__(self, held: int = 600_000, longest: int = 200):
        self.held = held
        self.longest = longest
        self.known: dict[str, dict] = {" ": {}, "": {}}  # words by what stands before them
        self.older: dict[str, dict] = {" ": {}, "": {}}
        self.long: list[tuple[str, str]] = []

    def compute(self, strings: list[str]) -> list:
        raise NotImplementedError

    def words(self, words: list[str], before: str) -> list:
        """Values of words of letters, `before` (a space or nothing) in front of each."""
        return self.compute([before + w for w in words])

    def spread(self, values: list, at: np.ndarray, bounds: np.ndarray) -> list:
        """The value of each text: the ones of its chunks, ``values[at[bounds[k]:bounds[k + 1]]]``, together."""
        raise NotImplementedError

    def _of_words(self, words: list[str], before: str) -> dict:
        """Values of `words` with `before` in front, by word; takes them from memory where it can."""
        known, older = self.known[before], self.older[before]
        missing = set(words) - known.keys()
        again = missing & older.keys()
        known.update(zip(again, map(older.__getitem__, again)))
        known.update(zip(fresh := list(missing - again), self.words(fresh, before)))
        self.long += [(before, w) for w in fresh if len(w) > self.longest]
        return known

    def _forget(self) -> None:
        for before, w in self.long:
            self.known[before].pop(w, None)
        self.long.clear()
        for before, known in self.known.items():
            if len(known) > self.held // 2:
                self.older[before], self.known[before] = known, {}

    def _values(self, pieces: list[str]) -> list:
        """Values of distinct pieces (the space before each left out); None where a piece begins with white space or is empty."""
        cores = [p.rstrip(_TAIL) for p in pieces]
        plain = list(map(str.isalpha, cores))
        odd = [k for k, ok in enumerate(plain) if not ok]
        lined = {k: f for k in odd if "\n" in pieces[k] and all(f := [_word(x) for x in pieces[k].split("\n")])}
        own = self._of_words([c for c, ok in zip(cores, plain) if ok] + [f[0][0] for f in lined.values()], " ")
        tails = list({p[len(c):] for p, c, ok in zip(pieces, cores, plain) if ok}.union([t for f in lined.values() for _, t in f]))
        after = dict(zip(tails, self.compute(tails)))
        out = [own[c] + after[p[len(c):]] if ok else None for p, c, ok in zip(pieces, cores, plain)]
        if lined:
            inner = self._of_words([w for f in lined.values() for w, _ in f[1:]], "")
            feed = self.compute(["\n"])[0]
            for k, f in lined.items():
                value = own[f[0][0]] + after[f[0][1]]
                for w, tail in f[1:]:
                    value = value + feed + inner[w] + after[tail]
                out[k] = value
        whole = [k for k in odd if k not in lined and pieces[k] and not pieces[k][0].isspace()]  # else no boundary: such texts are cut by the pattern
        for k, value in zip(whole, self.compute([" " + pieces[k] for k in whole])):
            out[k] = value
        self._forget()
        return out

    def values(self, texts: list[str]) -> list:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        # Words of ASCII letters and the punctuation after them: two values each, so only distinct words and distinct tails are touched one by one.
        cores = pc.utf8_rtrim(coded.dictionary, _TAIL)
        plain = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False)
        words = cores.filter(pa.array(plain)).dictionary_encode()
        tails = _after(coded.dictionary.filter(pa.array(plain)), cores.filter(pa.array(plain))).dictionary_encode()
        known, listed = words.dictionary.to_pylist(), tails.dictionary.to_pylist()
        values = list(map(self._of_words(known, " ").__getitem__, known)) + self.compute(listed)
        nothing = len(values)
        first, second = np.empty(len(plain), np.int64), np.full(len(plain), nothing)
        first[plain], second[plain] = words.indices.to_numpy(), len(known) + tails.indices.to_numpy().astype(np.int64)
        values += self.compute([""])
        first[~plain] = len(values) + np.arange(int((~plain).sum()))
        others = self._values(coded.dictionary.filter(pa.array(~plain)).to_pylist())
        by_pattern = np.zeros(len(plain), bool)
        by_pattern[~plain] = [v is None for v in others]
        values += [values[nothing] if v is None else v for v in others]
        # The first piece of a text has no space before it.
        begins = at[bounds[:-1]]
        heads, head = np.unique(begins, return_inverse=True)
        odd = np.empty(0, np.int64)
        if by_pattern.any():
            found = by_pattern[at]
            found[bounds[:-1]] = False
            odd = np.flatnonzero(np.add.reduceat(found, bounds[:-1], dtype=np.int64))
        places = np.stack([first[at], second[at]], axis=1)
        places[bounds[:-1], 0], places[bounds[:-1], 1] = len(values) + head, nothing
        values += self.compute(coded.dictionary.take(pa.array(heads)).to_pylist())
        out = self.spread(values, places.reshape(-1), bounds * 2)
        for k in odd.tolist():
            out[k] = self._by_pattern(texts[k])
        return out

    def _by_pattern(self, text: str):
        """For texts with runs of white space."""
        chunks = _CHUNKS.split(text)
        distinct = list(dict.fromkeys(chunks[1:]))
        own = self._values([c[1:] for c in distinct])
        number = {c: k for k, c in enumerate(distinct)}
        at = np.array([len(own), *map(number.__getitem__, chunks[1:])])
        return self.spread(own + self.compute(chunks[:1]), at, np.array([0, len(at)]))[0]


class ChunkEncoder(Chunks):
    """Ids by the tokenizers library from a byte-level BPE file.

    Special strings in texts are handled as the library does by default, or with
    `special_as_text` read as ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, **limits: int):
        super().__init__(**limits)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.symbols = dict(enumerate(byte_symbols()))
        plain = self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        self.model = self.tokenizer.model if plain else None

    def compute(self, strings: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def words(self, words: list[str], before: str) -> list[bytes]:
        """A word is one pre-token, so the library's model takes it as it is, in the symbols of its bytes."""
        if self.model is None:
            return super().words(words, before)
        split, symbols, code = self.model.tokenize, self.symbols, self.code
        head = before.translate(symbols)
        shown = [head + (w if w.isascii() else w.encode().decode("latin-1").translate(symbols)) for w in words]  # letters of ASCII stand for themselves
        return [array(code, [t.id for t in split(w)]).tobytes() for w in shown]

    def spread(self, values: list[bytes], at: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        width = self.dtype.itemsize
        ends = np.append(0, np.cumsum([len(v) // width for v in values]))
        ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(values), self.dtype))).take(pa.array(at))
        cuts = (ids.offsets.to_numpy()[bounds] * width).tolist()
        data = ids.values.to_numpy().tobytes()
        return [data[a:b] for a, b in itertools.pairwise(cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in `dtype`."""
        return self.values(texts)


def encoder(path: str, special_as_text: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return remembered(("encoder", path, special_as_text), lambda: ChunkEncoder(path, special_as_text))


def byte_symbols() -> list[str]:
    """The visible character by which byte-level vocabularies write each byte: itself, or the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
