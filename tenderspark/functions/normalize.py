"""Canonical forms of notice header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderspark.fixed import ABBREVIATIONS, SOURCE_NAMES, STATUSES
from tenderspark.functions.common import blank_to_null, col, let, lookup, squeeze, strip, words


def canonical_source(c: Column | str) -> Column:
    return F.coalesce(lookup(F.lower(strip(c)), SOURCE_NAMES), F.lit("other"))


def canonical_status(c: Column | str, strict: bool = False) -> Column:
    """Known status, else `active`; with `strict` an unknown status stays as it is."""
    def pick(s: Column) -> Column:
        other = F.when(s != "", s).otherwise("active") if strict else F.lit("active")
        return F.when(s.isin(*STATUSES), s).otherwise(other)

    return let(F.lower(strip(F.coalesce(col(c), F.lit("")))), pick)


def canonical_phone(c: Column | str) -> Column:
    """``ddd-ddd-dddd`` for ten digits (or eleven with a leading 1), else ``+digits``."""
    def shape(d: Column) -> Column:
        national = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), d.substr(2, 10))
        return (F.when(d == "", F.lit(None).cast("string"))
                .when(national.isNotNull(), F.regexp_replace(national, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"))
                .otherwise(F.concat(F.lit("+"), d)))

    return let(F.regexp_replace(col(c), r"[^0-9]", ""), shape)


def canonical_email(c: Column | str) -> Column:
    """Trim and lower-case what follows the last at sign."""
    def shape(e: Column) -> Column:
        domain = F.substring_index(e, "@", -1)
        local = e.substr(F.lit(1), F.length(e) - F.length(domain))
        return F.when(F.contains(e, F.lit("@")), F.concat(local, F.lower(domain))).otherwise(e)

    return F.when(col(c) != "", let(strip(c), shape))


def clean_title(c: Column | str) -> Column:
    return squeeze(c)


def contact_name(c: Column | str) -> Column:
    return blank_to_null(c)


def expand_abbreviations(c: Column | str) -> Column:
    """Spell out known abbreviations word by word, keeping a trailing comma, semicolon or colon."""
    shape = r"^([A-Za-z][A-Za-z.]*)([,;:]?)$"

    def one(token: Column) -> Column:
        word = F.regexp_extract(token, shape, 1)
        spelled = F.coalesce(lookup(word, ABBREVIATIONS), lookup(F.regexp_replace(word, r"\.+$", ""), ABBREVIATIONS))
        return F.when(spelled.isNotNull(), F.concat(spelled, F.regexp_extract(token, shape, 2))).otherwise(token)

    return F.array_join(F.transform(words(col(c)), one), " ")


def safe_id(c: Column | str, default: str) -> Column:
    """Identifier usable in file names; `default` when nothing is left."""
    kept = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[^\w.\-]+", "_")
    return let(F.regexp_replace(kept, r"^[._]+|[._]+$", ""), lambda s: F.when(s == "", F.lit(default)).otherwise(s))


def share_link_id(c: Column | str) -> Column:
    """File id of a share link: the path form first, then the query form."""
    by_path = F.nullif(F.regexp_extract(col(c), r"/file/d/([^/?]+)", 1), F.lit(""))
    by_query = F.nullif(F.regexp_extract(col(c), r"[?&]id=([^&]+)", 1), F.lit(""))
    return F.coalesce(by_path, by_query)


def preview_link(c: Column | str, host: str) -> Column:
    """Embeddable link of a share link on `host`: the query form first, then the path form."""
    by_query = F.nullif(F.regexp_extract(col(c), r"[?&]id=([^&#]+)", 1), F.lit(""))
    by_path = F.nullif(F.regexp_extract(col(c), r"/d/([^/?#]+)", 1), F.lit(""))
    ident = F.when(F.try_parse_url(col(c), F.lit("HOST")) == host, F.coalesce(by_query, by_path))
    return F.concat(F.lit(f"https://{host}/file/d/"), ident, F.lit("/preview"))
