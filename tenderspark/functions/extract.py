"""Single fields read out of notice text and portal records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderspark.fixed import (CLASS_KEYWORDS, CLASS_PREFIXES, COMMODITY_PREFIXES, MANDATORY_WORDS, MEETING_WORDS,
                               ZONES)
from tenderspark.functions.common import (blank_to_null, col, contains_any, drop_blank, first_match, let, lookup,
                                          squeeze, starts_with_any)

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ISO_STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2}|Z)?"
LABELLED_PHONE = r"(?i)(?:^|\n)\s*Phone\s*:?\s*(\d{3}/\d{3}-\d{4})\b"
OPEN_PHONE = r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s*|\d{3}[-./\s])\d{3}[-./\s]\d{4}\b"


def commodity_codes(c: Column | str) -> Column:
    """Distinct 8-digit codes with a code-table marker in the 120 characters before, in text order."""
    # The look-behind follows the digits, so it runs only where a code stands.
    found = F.regexp_extract_all(col(c), F.lit(r"(?s)\b(\d{8})\b(?<=(?i:unspsc).{0,114}\d{8})"), F.lit(1))
    number = lambda code: code.cast("int")
    return F.array_distinct(F.filter(found, lambda x: (x != "01012001") & ~number(x).between(19000000, 21000000)))


def industry_codes(many: Column, single: Column) -> Column:
    """Listed codes then the single one, trimmed, first occurrence of each."""
    trimmed = F.transform(F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(single)), lambda x: F.trim(x))
    return F.array_distinct(drop_blank(trimmed))


def primary_contact(contacts: Column) -> Column:
    """The contact typed `primary`, else the first."""
    primary = F.filter(contacts, lambda p: p["type"] == "primary")
    return F.coalesce(F.try_element_at(primary, F.lit(1)), F.try_element_at(contacts, F.lit(1)))


def office_path(path: Column, dept: Column) -> Column:
    return F.coalesce(blank_to_null(path), blank_to_null(dept))


def meeting_flag(c: Column | str) -> Column:
    """struct(required, detected_by): a mandatory bidder meeting stated in the text."""
    def read(text: Column) -> Column:
        event = contains_any(text, MEETING_WORDS)
        return F.struct((event & contains_any(text, MANDATORY_WORDS)).alias("required"),
                        F.when(event, "description_heuristic").alias("detected_by"))

    return let(F.lower(F.coalesce(col(c), F.lit(""))), read)


def first_email(c: Column | str) -> Column:
    return first_match(col(c), EMAIL)


def first_phone(c: Column | str) -> Column:
    """A labelled number, else the first number with separators."""
    return F.coalesce(first_match(col(c), LABELLED_PHONE, 1), first_match(col(c), OPEN_PHONE))


def first_iso(c: Column | str) -> Column:
    return first_match(col(c), ISO_STAMP)


def portal_timestamp(c: Column | str, default_zone: str, zone_suffix: bool = True, date_only: bool = True) -> Column:
    """First ``MM/DD/YYYY hh:mm AM/PM TZ`` as an instant.

    The suffix picks the zone when `zone_suffix` is set, else `default_zone` holds.
    A bare date counts as midnight when `date_only` is set.
    """
    time = r"\s+(\d{1,2}):(\d{2})\s*(AM|PM)"
    pattern = r"(?i)(\d{1,2})/(\d{1,2})/(\d{4})" + (f"(?:{time})?" if date_only else time) + r"(?:\s*([A-Z]{2,4}))?"

    def read(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
        half_day = F.upper(part(6))
        hour = (number(4) + F.when((half_day == "PM") & (number(4) != 12), 12)
                .when((half_day == "AM") & (number(4) == 12), -12).otherwise(0))
        zone = F.coalesce(lookup(F.upper(part(7)), ZONES), F.lit(default_zone)) if zone_suffix else F.lit(default_zone)
        stamp = F.try_make_timestamp(number(3), number(1), number(2), hour, number(5), F.lit(0).cast("decimal(16,6)"), zone)
        return F.when(text.rlike(pattern), stamp)

    return let(squeeze(c), read)


def content_hash(ident: Column, text: Column) -> Column:
    """Version, id and 12 hex digits over the id and the first 8000 characters."""
    seed = F.concat(ident, F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(8000)))
    return F.concat(F.lit("v1-"), ident, F.lit("-"), F.left(F.sha2(seed, 256), F.lit(12)))


def relevant_by_commodity(codes: Column, prefixes=COMMODITY_PREFIXES) -> Column:
    return F.exists(codes, lambda x: starts_with_any(F.regexp_replace(x, r"\D", ""), prefixes))


def relevant_by_class(codes: Column, title: Column, text: Column) -> Column:
    """Class codes decide where there are any; otherwise keywords of title and text."""
    by_code = F.exists(codes, lambda x: starts_with_any(F.trim(F.regexp_replace(x, "-", "")), CLASS_PREFIXES))
    by_word = let(F.lower(F.concat_ws(" ", title, text)), lambda s: contains_any(s, CLASS_KEYWORDS))
    return F.when(F.size(codes) > 0, by_code).otherwise(by_word)


def class_code_row(line: Column) -> Column:
    """struct(code, description) of one ``code - description`` line, null where it is none.

    A description printed twice in a row is kept once.
    """
    shape = r"^([0-9][0-9\-]{1,12})\s*[-:]?\s*(.*)$"

    def once(text: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")
        left = F.trim(F.substring(text, F.lit(1), half))
        right = F.trim(F.substring(text, half + 1, F.length(text)))
        return F.when((text != "") & (left == right), left).otherwise(text)

    def read(text: Column) -> Column:
        return F.when(text.rlike(shape), F.struct(
            F.regexp_extract(text, shape, 1).alias("code"),
            let(F.trim(F.regexp_extract(text, shape, 2)), once).alias("description")))

    return let(squeeze(line), read)
