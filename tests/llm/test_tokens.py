import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from tenderspark.llm import bpe, chat, huffman
from tenderspark.llm.common import texts
from tenderspark.llm.tokens import ChunkEncoder, crc_of

ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "!!", "<|endoftext|>", "1", "23", "　", "\x1c", "\xa0", ".", ",", "日本", "\U0001f600",
            "x'll", "_", "'", "\x85", "²", "aaaa", "́"]


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("limits", [{}, {"held": 5}, {"longest": 2}])
def test_chunks_give_the_ids_of_the_library(path, library, limits):
    strings = some_texts(4000)
    own = ChunkEncoder(path, **limits).encode(strings)
    assert [np.frombuffer(b, "<u2").tolist() for b in own] == [e.ids for e in library.encode_batch_fast(strings, add_special_tokens=False)]


def test_merges_give_the_counts_of_the_library(path, library):
    strings = some_texts(4000, 2) + ["x" * 5000, "ab" * 3000]
    assert bpe.MergeCounter(path).values(strings) == [len(e.ids) for e in library.encode_batch_fast(strings, add_special_tokens=False)]


def test_counts_of_odd_rows(odd, path, library):
    got = bpe.count_tokens(odd, path, 20).toPandas()
    want = texts(odd).toPandas()
    n = [len(library.encode(t, add_special_tokens=False).ids) for t in want["text"]]
    assert got["n_tokens"].tolist() == n and got["over_limit"].tolist() == [x > 20 for x in n]
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in want["text"]]
    assert bpe.count_tokens(odd.limit(0), path, 20).count() == 0


def test_escaping_is_undone_and_leaves_no_control_string():
    parts = [*chat.CONTROLS, "\\", "<", "s>", "[", "INST]", " ok ", "/s>"]
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(shown := chat.escape(text)) == text
        assert not any(c in shown for c in chat.CONTROLS)


def digests(rows):
    rows = [(role or "", text or "") for role, text in rows]
    loss = "".join(t for r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chats_read_back(spark, path, monkeypatch):
    turns = {None: [("user", "lost"), (None, None)], 1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("tool [/ROLE]", "[ROLE]x")],
             2: [("assistant", None)], 3: [("system", "s"), *[("user" if k % 2 else "assistant", f"téxt {k} \U0001f600 " * 50) for k in range(300)]]}
    rows = [(c, k, r, t, 7) for c, ts in turns.items() for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ids int")
    monkeypatch.setattr(chat, "PIECE", 500)
    formatted = chat.format_chats(df, path)
    got = {r["conv_id"]: r for r in chat.read_chats(formatted, path).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c if c is None else int(c): digests(ts) for c, ts in turns.items()}
    # The formatted text, made plainly.
    name = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
    plain = {c: "<s>" + "".join((name.get(r) or f"[ROLE]{chat.escape(r or '')}[/ROLE]") + chat.escape(t or "") + "</s>" for r, t in ts) for c, ts in turns.items()}
    assert {c: r["formatted_chars"] for c, r in got.items()} == {c: len(t) for c, t in plain.items()}
    assert chat.read_chats(chat.format_chats(df.limit(0), path), path).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        for longest in (10, 16):
            lengths = huffman.code_lengths(counts, longest)
            assert lengths.max() <= longest and (n == 1 or abs((2.0 ** -lengths).sum() - 1) < 1e-12)
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert (counts * huffman.code_lengths(counts)).sum() == total


def test_stored_ids_read_back(spark, odd, path, library, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 300)
    got = huffman.read_ids(spark, huffman.write_ids(odd, path, per_bucket=900)).toPandas()
    rows = sorted(((r["doc_id"], r["text"]) for r in texts(odd).collect()), key=lambda r: (r[0] is not None, r[0]))
    ids = [[*library.encode(t, add_special_tokens=False).ids, 0] for _, t in rows]
    want = pd.DataFrame({"doc_id": [d for d, _ in rows], "start": np.cumsum([0, *map(len, ids[:-1])]), "n_tokens": list(map(len, ids)),
                         "ids_crc32": [crc_of(np.array(i, np.uint32)) for i in ids]})
    pd.testing.assert_frame_equal(got.sort_values("start", ignore_index=True), want, check_dtype=False)
    assert huffman.read_ids(spark, huffman.write_ids(odd.limit(0), path)).count() == 0
