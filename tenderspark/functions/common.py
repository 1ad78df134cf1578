"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Separators of the packed tables below; they do not occur in fixed values.
_ITEM, _PART = "\u0001", "\u0002"
SPACES = " \t\n\u000b\f\r"


def literals(values: Iterable[str]) -> Column:
    """A constant string array; one packed literal, which the optimizer folds."""
    return F.split(F.lit(_ITEM.join(values)), _ITEM)


@lru_cache(maxsize=None)
def one_of(words: tuple[str, ...]) -> str:
    """Pattern for any of the given texts, with common beginnings written once.

    One scan with such a pattern costs far less than a search per text.
    """
    if "" in words:
        return ""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(word[1:])
    quote = lambda c: c if c.isalnum() or c == " " else "\\" + c
    branches = [quote(c) + one_of(tuple(rest)) for c, rest in heads.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


@lru_cache(maxsize=None)
def longest_of(words: tuple[str, ...]) -> str:
    """As `one_of`, but of words that begin alike the longest is taken."""
    heads: dict[str, list[str]] = {}
    for word in filter(None, words):
        heads.setdefault(word[0], []).append(word[1:])
    quote = lambda c: c if c.isalnum() or c == " " else "\\" + c
    branches = [quote(c) + longest_of(tuple(rest)) for c, rest in heads.items()]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "")


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True where `text` holds one of the fixed `needles`."""
    return text.rlike(one_of(tuple(needles)))


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return text.rlike("^" + one_of(tuple(prefixes)))


def lookup(key: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Value of `key` in a fixed table, else null."""
    packed = _ITEM.join(k + _PART + v for k, v in pairs)
    return F.try_element_at(F.str_to_map(F.lit(packed), F.lit(_ITEM), F.lit(_PART)), key)


def blank_to_null(c: Column | str) -> Column:
    return filled(strip(c))


def filled(c: Column) -> Column:
    """Null instead of an empty text."""
    return let(c, lambda x: F.when(x != "", x))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def drop_blank(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def words(c: Column) -> Column:
    """White-space separated words."""
    return drop_blank(F.split(c, r"\s+"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column, min_length: int, stop: Iterable[str]) -> Column:
    """Distinct lower-case alphanumeric tokens longer than `min_length`, less stop words."""
    banned = literals(stop)
    parts = F.split(F.lower(c), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(
        parts, lambda t: (F.length(t) > min_length) & ~F.array_contains(banned, t)))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of `pattern`, null where there is none."""
    return filled(F.regexp_extract(text, pattern, group))


def first_index(items: Column, predicate) -> Column:
    """Zero-based index of the first array element that satisfies `predicate`, else null."""
    hits = F.filter(F.transform(items, lambda x, i: F.when(predicate(x), i)), lambda i: i.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def take_from(items: Column, start: Column, count: Column | int) -> Column:
    """`count` elements from zero-based `start`."""
    return F.slice(items, start + 1, F.lit(count) if isinstance(count, int) else count)


def head(items: Column, count: int) -> Column:
    return F.slice(items, 1, count)


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))




def let(value: Column, fn) -> Column:
    """``fn(value)`` with `value` computed once per row however often `fn` uses it."""
    return F.transform(F.array(value), lambda v: fn(v))[0]
