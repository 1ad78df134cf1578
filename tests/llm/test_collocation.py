"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tenderspark.llm import collocation
from tenderspark.llm.common import Scratch


def plain(rows, least, top):
    """All phrases of `rows` (lang, text) by the definition."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", text):
            words = re.findall("[^ \\t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[k:k + size]) for k in range(len(words) - size + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *words), a in frequent.items():
        if len(words) == 2 and any(100 * b >= 50 * a and lang == p[0] and tuple(words) in (p[1:3], p[2:4]) for p, b in frequent.items() if len(p) == 4):
            continue
        cuts = [(1000000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(words).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items()
            for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def rows_of(seed, n, words, lang=("en", "de", None, "und", "")):
    rng = random.Random(seed)
    return [(rng.choice(lang), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


WORDS = ["a", "b", "A", "the", "of the", "new york city", "é", "\0", "\1", "\1\2", "a\0", "a\1b", "\x0e", "\x85", "\u3000", "日本", "-"]


@pytest.mark.parametrize("seed,least,top", [(1, 10, 2000), (2, 2, 50), (3, 1, 7)])
def test_equals_a_plain_count(spark, seed, least, top):
    rows = [*rows_of(seed, 150, WORDS), (None, None), ("en", ""), ("en", " ."), ("en", "x"), ("en", "x")]
    docs = spark.createDataFrame([(None, *r, 1, "x", 2) for r in rows], "doc_id long, lang string, text string, n int, key string, size int")
    assert found(collocation.collocations(docs, least, top)) == plain(rows, least, top)


def test_phrases_of_one_hot_word_lie_in_many_partitions(spark, monkeypatch):
    """One word begins, ends and fills most phrases, and every partition holds a few rows."""
    rng = random.Random(5)
    rows = [("en", " ".join(x for _ in range(30) for x in ("hot", f"w{rng.randint(0, 40)}"))) for _ in range(60)] + [("en", "hot hot hot hot")] * 20
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocation, "sorted_stream", lambda df: df.repartitionByRange(40, "key").sortWithinPartitions("key"))
    assert found(collocation.collocations(docs, 3, 2000)) == plain(rows, 3, 2000)
    scratch = Scratch(spark, "test")
    counts = collocation.phrase_counts(docs, 3, scratch)
    parts = collocation.with_parts(counts.filter("size > 0"), scratch)
    assert parts.filter("(size > 1 and up1 is null) or (size > 2 and up2 is null)").count() == 0 and parts.filter("size > 1").count() > 40


def test_no_rows(spark):
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocation.collocations(docs).count() == 0 and collocation.collocations(docs.limit(0)).count() == 0


def test_a_text_longer_than_a_slice(spark):
    docs = spark.createDataFrame([("en", "one two three, " * 1_300_000)], "lang string, text string")  # 20 MB
    n = 1_300_000
    assert found(collocation.collocations(docs)) == {("en", 1, "one two three", n, n, n, 3 * n, 1000000)}


def test_scores_are_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        a = int(rng.integers(1, 10**15))
        rows.append((a, a + int(rng.integers(0, 10**15 - a)), a + int(rng.integers(0, 10**15 - a))))
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(collocation.score(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * a * a // (left * right) for a, left, right in rows]
