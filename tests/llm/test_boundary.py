"""Encoding with forced boundaries against the library."""

import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tenderspark.llm import boundary, queries
from tenderspark.llm.common import read, texts
from tenderspark.llm.tokens import vocabulary

ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "!!", "<|endoftext|>", "1", "23", "\u3000", "\x1c", "\xa0", ".", ",", "日本", "\U0001f600",
            "x'll", "_", "'", "\x85", "²", "aaaa", "\u0301", "Σ", "ΑΣ", "İ", "ß", "<|startoftext|>", "\x0b", "Hello", "\u200d", "\ufeff", "</w>", "\0", "\x7f"]


@pytest.fixture(scope="module")
def words_path():
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(words_path):
    own = Tokenizer.from_file(words_path)
    own.no_truncation()
    own.no_padding()
    return own


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def some_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"held": 5}, {"longest": 2}])
def test_ids_and_texts_are_the_ones_of_the_library(words_path, library, limits):
    strings = [*some_texts(4000, 1), "ab" * 3000, "x" * 5000, "é" * 700, "", "AbC " * 2000]
    ids = boundary.Encoder(words_path, **limits).encode(pa.array(strings))
    want = [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]
    assert ids.to_pylist() == want
    assert boundary.Decoder(words_path).decode(ids) == [library.decode(i, skip_special_tokens=False) for i in want]


def test_cuts_fall_where_no_token_has_the_pair(words_path):
    own = boundary.Encoder(words_path)
    rng = random.Random(2)
    known = [t for t in own.vocab if len(t.removesuffix("</w>")) > 1]
    assert all(own.cut(t.removesuffix("</w>")) == [t.removesuffix("</w>")] for t in rng.sample(known, 3000))
    symbols = "".join(rng.choice("abqzxj~#") for _ in range(400))
    pieces = own.cut(symbols)
    assert "".join(pieces) == symbols and len(pieces) > 1
    assert all(a[-1] + b[0] not in own.inside for a, b in zip(pieces, pieces[1:]))


def test_decoding_of_a_byte_level_file(path):
    byte_level = Tokenizer.from_file(path)
    ids = [e.ids for e in byte_level.encode_batch(some_texts(500, 3), add_special_tokens=False)] + [[10, 220, 50256, 126]]
    assert boundary.Decoder(path).decode(pa.array([*ids, None, []])) == [byte_level.decode(i, skip_special_tokens=False) for i in ids] + ["", ""]


def test_files_that_keep_white_space_are_refused(path):
    with pytest.raises(ValueError):
        boundary.Encoder(path)


def test_odd_rows(spark, odd, words_path, library):
    got = boundary.digests(boundary.decode(boundary.encode(odd, words_path), words_path)).toPandas()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts(odd).toPandas()["text"]]
    assert got["n_tokens"].tolist() == list(map(len, want))
    assert got["ids_sha256"].tolist() == [digest(" ".join(map(str, i))) for i in want]
    assert got["decoded_sha256"].tolist() == [digest(library.decode(i, skip_special_tokens=False)) for i in want]
    assert got["doc_id"].isna().sum() == 1
    assert boundary.encode(odd.limit(0), words_path).count() == 0


def test_a_text_longer_than_a_batch(spark, words_path, library):
    long = "Some words, and " * 700_000  # 11 MB
    row = boundary.digests(boundary.decode(boundary.encode(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string"), words_path), words_path)).orderBy("doc_id").first()
    ids = library.encode("some words, and", add_special_tokens=False).ids * 700_000
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == digest(" ".join(map(str, ids)))


def test_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op13_bpe_encoding(spark, sf_dir).collect()}
    docs = texts(read(spark, sf_dir, "documents")).collect()
    assert len(got) == len(docs)
    for (doc, text), e in zip(docs, library.encode_batch([d["text"] for d in docs], add_special_tokens=False)):
        assert tuple(got[doc])[1:] == (len(e.ids), digest(" ".join(map(str, e.ids))), digest(library.decode(e.ids, skip_special_tokens=False)))
