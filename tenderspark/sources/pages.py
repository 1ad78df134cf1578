"""Landed web pages -> listing rows and commodity codes.

Everything about one page is done inside its row with array functions, so no
page is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.common import drop_blank, let, strip
from tenderspark.sources.portals import last_segment

ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
HREF = r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
CELL = r"(?is)<td\b[^>]*\bdata-if-label\s*=\s*[\"'](?:{})[\"'][^>]*>.*?</td>"
LABEL = r"(?is)\bdata-if-label\s*=\s*[\"']([^\"']*)[\"']"
CLICKABLE = r"(?is)<tbody\b[^>]*\bclass\s*=\s*[\"'][^\"']*clickable[^\"']*[\"'][^>]*>.*?</tbody>"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
CAPTURED = ("CaptureResults struct<unspscCodeBody array<struct<Children struct<"
            "unspscClassification array<struct<Properties struct<text string>>>, "
            "unspscDescription array<struct<Properties struct<text string>>>>>>>")
ROW = "array<struct<external_id string, name string, url string>>"
CODE_ROWS = "array<struct<code string, description string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def decode(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def inner_text(element: Column) -> Column:
    """Text pieces of an element, each trimmed, joined by blanks."""
    return F.array_join(drop_blank(F.transform(F.split(decode(element), r"<[^>]+>"), strip)), " ")


def absolute_url(base: str, href: Column) -> Column:
    root = "/".join(base.split("/")[:3])
    scheme = base.split(":")[0]
    return (F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
            .when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(base), href)))


def _first_of_each(rows: Column, key) -> Column:
    """First array element per key, in order."""
    return let(F.transform(rows, key), lambda keys: F.filter(rows, lambda r, i: F.array_position(keys, key(r)) == i + 1))


def link_rows(html: Column, base: str) -> Column:
    """Event links of a listing page; first row per URL."""
    def row(anchor: Column) -> Column:
        name = inner_text(anchor)
        url = absolute_url(base, F.regexp_extract(anchor, HREF, 1))
        token = F.try_element_at(F.filter(F.transform(F.split(name, r"\s+"), lambda w: F.btrim(w, F.lit("()[]{}:,-"))),
                                          lambda w: w.rlike("^[A-Za-z0-9]{6,}$")), F.lit(1))
        ident = F.coalesce(F.nullif(strip(last_segment(url)), F.lit("")), token)
        return F.struct(ident.alias("external_id"), name.alias("name"), url.alias("url"))

    wanted = F.filter(_all(html, ANCHOR), lambda a: F.lower(F.regexp_extract(a, HREF, 1)).rlike("/event/|auc_id"))
    rows = F.filter(F.transform(wanted, row), lambda r: r["name"] != "")
    return _first_of_each(rows, lambda r: r["url"])


def grid_rows(html: Column, base: str, unit: str) -> Column:
    """Rows of a clickable grid: an id cell with six digits or more and the name cell after it."""
    start = F.struct(F.lit("").alias("ident"), F.array().cast(ROW).alias("out"))

    def cell(acc: Column, c: Column) -> Column:
        text = inner_text(c)
        url = F.concat(F.lit(f"{base}event/{unit}/"), acc["ident"])
        made = F.struct(acc["ident"].alias("external_id"), text.alias("name"), url.alias("url"))
        grown = F.when((text != "") & (F.length(acc["ident"]) >= 6), F.concat(acc["out"], F.array(made))).otherwise(acc["out"])
        is_id = F.regexp_extract(c, LABEL, 1) == "tdEventId"
        return F.struct(F.when(is_id, F.regexp_replace(text, r"\D", "")).otherwise(acc["ident"]).alias("ident"),
                        F.when(is_id, acc["out"]).otherwise(grown).alias("out"))

    def body(block: Column) -> Column:
        return F.aggregate(_all(block, CELL.format("tdEventId|tdEventName")), start, cell, lambda acc: acc["out"])

    return _first_of_each(F.flatten(F.transform(_all(html, CLICKABLE), body)), lambda r: r["url"])


def listing(df: DataFrame, base: str, unit: str) -> DataFrame:
    """(page_id, html) -> (page_id, pos, external_id, name, url); the grid counts only where no link is found."""
    rows = let(link_rows(F.col("html"), base), lambda links: F.when(F.size(links) > 0, links).otherwise(grid_rows(F.col("html"), base, unit)))
    return df.select("page_id", F.posexplode(rows).alias("pos", "r")).select("page_id", "pos", "r.external_id", "r.name", "r.url")


def listing_links(df: DataFrame, base: str) -> DataFrame:
    return df.select("page_id", F.posexplode(link_rows(F.col("html"), base)).alias("pos", "r")) \
        .select("page_id", "pos", "r.external_id", "r.name", "r.url")


def listing_grid(df: DataFrame, base: str, unit: str) -> DataFrame:
    return df.select("page_id", F.posexplode(grid_rows(F.col("html"), base, unit)).alias("pos", "r")) \
        .select("page_id", "pos", "r.external_id", "r.name", "r.url")


def table_codes(html: Column) -> Column:
    """Codes of exactly eight digits from table cells, with the description cell after each."""
    start = F.struct(F.lit(None).cast("string").alias("code"), F.array().cast(CODE_ROWS).alias("out"))

    def cell(acc: Column, c: Column) -> Column:
        text = inner_text(c)
        digits = F.regexp_replace(text, r"\D", "")
        is_code = F.regexp_extract(c, LABEL, 1) == "unspscClassification"
        made = F.struct(acc["code"].alias("code"), text.alias("description"))
        grown = F.when(acc["code"].isNotNull(), F.concat(acc["out"], F.array(made))).otherwise(acc["out"])
        return F.struct(F.when(is_code & (F.length(digits) == 8), digits).alias("code"),
                        F.when(is_code, acc["out"]).otherwise(grown).alias("out"))

    return F.aggregate(_all(html, CELL.format("unspscClassification|unspscDescription")), start, cell, lambda acc: acc["out"])


def embedded_codes(html: Column) -> Column:
    """Codes from the capture results a page carries in a script."""
    def first_text(entries: Column) -> Column:
        texts = F.filter(F.transform(entries, lambda e: strip(e["Properties"]["text"])), lambda x: x.isNotNull() & (x != ""))
        return F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))

    def row(entry: Column) -> Column:
        child = entry["Children"]
        return F.struct(F.regexp_replace(first_text(child["unspscClassification"]), r"\D", "").alias("code"),
                        first_text(child["unspscDescription"]).alias("description"))

    scripts = F.filter(_all(html, SCRIPT, 1), lambda s: F.contains(s, F.lit('"CaptureResults"')))
    body = F.regexp_extract(F.try_element_at(scripts, F.lit(1)), r'(?s)\{[^{]*"CaptureResults".*\}', 0)
    entries = F.from_json(body, CAPTURED)["CaptureResults"]["unspscCodeBody"]
    found = F.filter(F.transform(entries, row), lambda r: F.length(r["code"]) == 8)
    return F.coalesce(found, F.array().cast(CODE_ROWS))


def page_codes(df: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, pos, code, description): table codes, then embedded ones, each pair once."""
    rows = F.array_distinct(F.concat(table_codes(F.col("html")), embedded_codes(F.col("html"))))
    return df.select("page_id", F.posexplode(rows).alias("pos", "r")).select("page_id", "pos", "r.code", "r.description")
