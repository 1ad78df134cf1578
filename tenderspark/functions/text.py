"""Cleaning of notice descriptions, attachment text and web pages.

Texts are cut into arrays of lines, paragraphs or sentences and worked on with
array functions, so every step stays in the JVM and reads the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tenderspark.fixed import (ADDENDUM_WORDS, ADMIN_LEAD_PHRASES, DOCUMENT_LEAD_PHRASES, FILLER_PHRASES,
                               PLACEHOLDER_MARKERS, PROJECT_SIGNAL_PHRASES, PROSE_WORDS, TRAILER_LINES, TRAILER_PREFIXES)
from tenderspark.functions.common import (col, contains_any, count_matches, drop_blank, filled, first_index, head, let, literals,
                                          squeeze, starts_with_any, strip)

BLANK_LINE = r"\n\s*\n"
LINE_END = r"\r\n|\n|\r"
MARK = "\u0001"

# --- fixed values: line patterns ---------------------------------------------
BODY_ANCHOR = r"(?i)^\s*(?:\d+\.\s+)?description\s*:?\s*$"
HEADER_LABEL = (r"(?i)^\s*(event\s*details|event\s*id|format/?type|published\s*date|dept|event\s*version|"
                r"event\s*end\s*date)\s*:?\s*$")
EVENT_LINE = r"(?i)^event\s*:\s*\S+\s*$"
DATE_LINE = r"^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$"
DATE_PREFIX = r"^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*[-–—:]\s*"
ADDENDUM_HEAD = (r"(?i)^\s*(this\s+is\s+(addendum|q\s*&\s*a|q\s+and\s+a)|addendum\s+\d+|q\s*&\s*a\b|"
                 r"amendment\s+\d+|errata\b)")
BULLET = r"^\s*(?:[\-\*•¿]|\d+[.)])\s+"
CODE_START = r"^\s*\d{2,}[\-/\.]"
NUMBER_START = r"^\s*[A-Z]\d+[A-Z0-9\-]{3,}\b"
FORM_LABEL = r"\b(NAME|EMAIL|ATTN|PHONE|FAX|ADDRESS|PART\s+[IVX]+)\s*:"
PAGE_NOISE = (
    r"Distribution Statement A\.\s*Approved for public release[^\n]*",
    r"THIS PAGE LEFT INTENTIONALLY BLANK",
    r"^\s*Page \d+ of \d+\s*$",
    r"FOR OFFICIAL USE ONLY",
    r"CHANGE\s+HISTORY",
)
SECTION_ANCHOR = (r"(?i)(?:^|[.!?]\s|\n)\s*(?:\d+\.\s+)?(?:statement\s+of\s+work|scope\s+of\s+work|"
                  r"description\s+of\s+services|description|sow)\s*:\s*(?:\n|$)")
SECTION_HEAD = (r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(?:scope|introduction|overview|background|purpose|"
                r"statement\s+of\s+work|sow|objective(?:s)?|executive\s+summary|general\s+information|summary|"
                r"description\s+of\s+services)\s*$")
FORM_WORDS = (r"i\s+certify\b", r"per\s+vaar\b", r"per\s+far\b", r"name,\s*date\s*:", r"approved\s+by\s*:", r"signature\s*:_+",
              r"distribution\s+statement\b")
FORM_STARTS = (
    r"brand\s+name\s+item\s*:", r"essential/significant\s+physical", r"salient\s+characteristics\b", r"supervisory\s+",
    r"contracting\s+officer\b", r"vacchcs\b", r"version\s+\d", r"far\s+\d", r"\d{1,2}/\d{1,2}/\d{2,4}\s*$",
    r"\d+\)\s*[a-z][a-z\-/ ]{2,50}(?:\s*[–—\-:])", r"\d+\)\s*[a-z][a-z &/]{2,35}\s*$",
    r"[A-Z][A-Z0-9'’\s,&/().\-]{1,80}\*\s*$",
)
FORM_LINE = r"(?im)^\s*(?:" + "|".join(FORM_STARTS) + r")|\b(?:" + "|".join(FORM_WORDS) + ")"
TITLE_LINE = r"^\s*(?:[A-Z][A-Za-z]+\s*){1,4}$"
CAPS_LINE = r"^\s*[A-Z][A-Z0-9\s,&/().\-]{4,80}\s*$"
CODE_LINE = r"^[A-Z0-9][A-Z0-9\-\s/]{1,40}$"
BLOCK_TAGS = "p|br|div|li|tr|ul|ol|h1|h2|h3|h4|h5|h6|table"


def _paragraphs(c: Column) -> Column:
    return F.split(c, BLANK_LINE)


def _sentence_cut(c: Column, starts: str) -> Column:
    return F.split(c, r"(?<=[.!?])\s+(?=[" + starts + "])")


def sentences(c: Column | str) -> Column:
    """Sentences of one paragraph: cut where a capital, digit or quote follows an end mark."""
    return drop_blank(F.transform(_sentence_cut(squeeze(c), "A-Z0-9“\"'"), strip))


def paragraph_sentences(c: Column | str) -> Column:
    """Sentences of every paragraph in text order."""
    return F.flatten(F.transform(_paragraphs(col(c)), sentences))


def is_filler(sentence: Column) -> Column:
    """Procurement boiler-plate or a form value line."""
    return let(strip(sentence), lambda s: s.rlike(CODE_START) | s.rlike(NUMBER_START) | contains_any(F.lower(s), FILLER_PHRASES))


def strip_addenda(c: Column | str) -> Column:
    """Remove dated addendum and Q&A entries."""
    def log_line(line: Column) -> Column:
        return line.rlike(DATE_PREFIX) & contains_any(F.lower(line), ADDENDUM_WORDS)

    def block(text: Column) -> Column:
        def with_filled(lines: Column, filled: Column) -> Column:
            dated = strip(filled[0]).rlike(DATE_LINE) & (F.size(filled) >= 2)
            dropped = dated & strip(filled[1]).rlike(ADDENDUM_HEAD)
            kept = F.filter(lines, lambda ln: ~(dated & ln.rlike(DATE_LINE)) & ~log_line(ln))
            return F.when(~dropped, strip(F.array_join(kept, "\n"))).otherwise("")

        return let(F.split(text, "\n"), lambda lines: let(
            F.filter(lines, lambda ln: strip(ln) != ""),
            lambda filled: F.when(F.size(filled) > 0, with_filled(lines, filled)).otherwise("")))

    return strip(F.array_join(drop_blank(F.transform(_paragraphs(col(c)), block)), "\n\n"))


def strip_admin_lead(c: Column | str, phrases: Iterable[str] = ADMIN_LEAD_PHRASES) -> Column:
    """Drop opening sentences with an administrative phrase up to the first other one."""
    def paragraph(p: Column) -> Column:
        return drop_blank(F.transform(_sentence_cut(p, "A-Z“\"'"), strip))

    def kept(s: Column) -> Column:
        return ~contains_any(F.lower(s), phrases)

    def first(items: Column, predicate) -> Column:
        # Mostly the first one fits; then the others are not looked at.
        return F.when(predicate(F.try_element_at(items, F.lit(1))), 0).otherwise(first_index(items, predicate))

    def from_first(paras: Column) -> Column:
        def rest(p0: Column) -> Column:
            opening = paras[p0]
            start = first(opening, kept)
            lead = F.array_join(F.slice(opening, start + 1, F.size(opening)), " ")
            later = F.transform(F.slice(paras, p0 + 2, F.size(paras)), lambda p: F.array_join(p, " "))
            return F.when(p0.isNotNull(), strip(F.array_join(drop_blank(F.concat(F.array(lead), later)), "\n\n")))

        return let(first(paras, lambda p: F.exists(p, kept)), rest)

    return filled(let(F.transform(_paragraphs(col(c)), paragraph), from_first))


def _running(blocks: Column, target: int) -> Column:
    """Leading blocks until their running length (plus two each) reaches `target`, joined by blank lines."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, b: Column) -> Column:
        more = F.struct((acc["total"] + F.length(b) + 2).alias("total"), F.concat(acc["out"], F.array(b)).alias("out"))
        return F.when(acc["total"] >= target, acc).otherwise(more)

    return F.aggregate(blocks, start, add, lambda acc: strip(F.array_join(acc["out"], "\n\n")))


def cap_paragraphs(c: Column | str, target: int = 1400) -> Column:
    """Whole leading paragraphs up to about `target` characters; shorter text stays as it is."""
    text = col(c)
    return F.when(F.length(text) <= target, text).otherwise(
        _running(drop_blank(F.transform(_paragraphs(text), strip)), target))


def sentence_units(c: Column | str) -> Column:
    """Sentence-like units: a bullet line is one unit, wrapped lines are joined and cut into sentences."""
    def line(ln: Column) -> Column:
        bullet = F.regexp_replace(strip(F.regexp_replace(ln, BULLET, "")), "[,;]+$", "")
        return (F.when(ln.rlike(BULLET), F.concat(F.lit(MARK + "B"), bullet, F.lit(MARK + "P")))
                .when(strip(ln) == "", F.lit(MARK + "P")).otherwise(F.concat(strip(ln), F.lit(" "))))

    def segment(s: Column) -> Column:
        return F.when(s.startswith("B"), F.array(s.substr(F.lit(2), F.length(s)))) \
            .otherwise(F.transform(_sentence_cut(strip(s.substr(F.lit(2), F.length(s))), "A-Z“\"'0-9"), strip))

    # Every segment is led by B (bullet) or P (prose).
    tagged = F.array_join(F.transform(F.split(col(c), LINE_END), line), "")
    return drop_blank(F.flatten(F.transform(F.split(F.concat(F.lit("P"), tagged), MARK), segment)))


def limit_sentences(c: Column | str, lo: int = 4, hi: int = 5) -> Column:
    """The first `hi` substantive units; fewer than `lo` of those bring the filler back."""
    text = col(c)

    def choose(long: Column) -> Column:
        good = head(F.filter(long, lambda u: ~is_filler(u)), hi)
        return let(good, lambda g: F.when(F.size(g) >= lo, g).otherwise(head(long, hi)))

    def render(units: Column) -> Column:
        ended = F.transform(units, lambda u: F.when(u.rlike(r"(?s)[.!?]$"), u).otherwise(F.concat(u, F.lit("."))))
        return F.when(F.size(units) == 0, text).otherwise(strip(F.array_join(ended, " ")))

    units = F.filter(sentence_units(text), lambda u: F.length(u) >= 25)
    return let(let(units, choose), render)


def description_body(c: Column | str) -> Column:
    """Lines between the description anchor and the first trailer, without labels and doubled blanks."""
    def trailer(ln: Column) -> Column:
        return let(F.lower(ln), lambda low: F.array_contains(literals(TRAILER_LINES), low) | starts_with_any(low, TRAILER_PREFIXES))

    def cut(body: Column) -> Column:
        end = first_index(body, trailer)
        return F.slice(body, 1, F.coalesce(end, F.size(body)))

    def body(lines: Column) -> Column:
        start = F.coalesce(first_index(lines, lambda ln: ln.rlike(BODY_ANCHOR)) + 1, F.lit(0))
        return F.slice(lines, start + 1, F.size(lines))

    lines = F.transform(F.split(col(c), "\n"), strip)
    kept = F.filter(let(let(lines, body), cut), lambda ln: ~ln.rlike(HEADER_LABEL) & ~ln.rlike(EVENT_LINE))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def clean_description(c: Column | str) -> Column:
    """The whole description clean-up; a row without a description takes none of its steps."""
    step = let(description_body(c), strip_addenda)
    step = let(step, lambda s: F.coalesce(strip_admin_lead(s), F.lit("")))
    step = let(step, cap_paragraphs)
    return F.when(col(c).isNotNull(), filled(let(step, limit_sentences)))


def _noise_free(c: Column) -> Column:
    for pattern in PAGE_NOISE:
        c = F.regexp_replace(c, "(?im)" + pattern, "")
    lines = F.filter(F.split(c, LINE_END), lambda ln: ~ln.rlike(r"\.{4,}"))
    return F.array_join(lines, "\n")


def section_body(c: Column) -> Column:
    """Text after the last `Scope of work:` style anchor, else after the first bare section head in 120 lines."""
    def after_head(lines: Column) -> Column:
        at = first_index(head(lines, 120), lambda ln: ln.rlike(SECTION_HEAD))
        return F.when(at.isNotNull(), F.array_join(F.slice(lines, at + 2, F.size(lines)), "\n"))

    marked = F.regexp_replace(c, SECTION_ANCHOR, MARK)
    return let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), F.substring_index(m, MARK, -1))
               .otherwise(F.coalesce(let(F.split(m, LINE_END), after_head), m)))


def form_line(line: Column) -> Column:
    """A header, banner, code or form line rather than prose."""
    return (line.rlike(FORM_LINE) | line.rlike(TITLE_LINE) | line.rlike(CAPS_LINE)
            | line.rlike(CODE_LINE))


def is_narrative(paragraph: Column) -> Column:
    """Reads like prose: long enough, not mostly capitals, with glue words."""
    p = strip(paragraph)
    letters = F.length(p) - F.length(F.regexp_replace(p, r"\p{L}+", ""))
    capitals = F.length(p) - F.length(F.regexp_replace(p, r"\p{Lu}+", ""))
    found = F.regexp_extract_all(F.lower(p), F.lit("[a-z]+"), F.lit(0))
    prose = let(found, lambda w: (F.size(w) >= 12)
                & (F.size(F.filter(w, lambda x: F.array_contains(literals(PROSE_WORDS), x))) >= 3))
    return (F.length(p) >= 60) & ~form_line(p) & ((letters == 0) | (capitals <= letters * 0.55)) & prose


def narrative_paragraphs(c: Column | str, target: int = 1800) -> Column:
    """Prose paragraphs in text order until about `target` characters."""
    lines = F.transform(F.split(col(c), LINE_END), strip)
    pruned = F.array_join(F.filter(lines, lambda ln: (ln == "") | ~form_line(ln)), "\n")
    paras = F.transform(_paragraphs(pruned), lambda p: strip(F.regexp_replace(p, r"\s+\n", "\n")))
    return _running(F.filter(paras, is_narrative), target)


def document_text(c: Column | str) -> Column:
    """Attachment text without page noise and lead pages, white space normalized."""
    body = section_body(_noise_free(col(c)))
    for pattern, new in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        body = F.regexp_replace(body, pattern, new)
    return strip(body)


def clean_document_text(c: Column | str) -> Column:
    """`document_text` reduced to its narrative paragraphs; itself where none is left."""
    def reduce(text: Column) -> Column:
        prose = let(narrative_paragraphs(text), lambda n: strip_admin_lead(n, DOCUMENT_LEAD_PHRASES))
        return F.coalesce(prose, text)

    return let(document_text(c), reduce)


def is_pure_admin(c: Column | str) -> Column:
    """Text that is all procurement process or form scaffolding."""
    def judge(text: Column) -> Column:
        low = F.lower(text)
        found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-/]+"), F.lit(0))
        shouting = let(found, lambda w: (F.size(w) < 8) | (F.size(F.filter(
            w, lambda x: (F.length(x) >= 3) & (F.upper(x) == x))) > F.size(w) * 0.20))
        short = (F.length(text) < 120) & ~contains_any(low, PROJECT_SIGNAL_PHRASES)
        return (text != "") & (contains_any(low, FILLER_PHRASES) | shouting
                               | (count_matches(text, r"\b\d+\.\s+[A-Z]") >= 2) | text.rlike(FORM_LABEL) | short)

    return let(F.coalesce(col(c), F.lit("")), judge)


def override_admin_description(df: DataFrame) -> DataFrame:
    """Replace a description that is pure form text by the statement of work."""
    admin = is_pure_admin(strip(F.coalesce("description", F.lit(""))))
    return df.withColumn("description", F.when(admin, filled(strip("statement_of_work"))).otherwise(F.col("description")))


def html_to_text(c: Column | str) -> Column:
    """Page text with block structure, by pattern: block tags become line ends, other tags go."""
    text = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.replace(text, F.lit(" "), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def _parsed_html():
    """Arrow function: text nodes of each page with line ends at block tags, read by a real parser."""
    blocks = frozenset(BLOCK_TAGS.split("|"))

    def read(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        class BlockText(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.out = []

            def handle_starttag(self, tag, attrs):
                if tag in blocks:
                    self.out.append("\n")

            def handle_endtag(self, tag):
                self.handle_starttag(tag, ())

            def handle_data(self, data):
                self.out.append(data)

        def text(page):
            parser = BlockText()
            parser.feed(page or "")
            parser.close()
            return "".join(parser.out)

        return pages.map(text)

    return F.pandas_udf(read, StringType())


def html_to_text_parsed(c: Column | str) -> Column:
    """As `html_to_text`, for malformed pages: tags are read by a parser in Arrow batches."""
    text = F.replace(_parsed_html()(col(c)), F.lit(" "), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def html_to_flat_text(c: Column | str, cap: int = 100000) -> Column:
    """Page text on one line, scripts and styles removed; the cap is part of the text field's definition."""
    text = col(c)
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    return F.left(squeeze(text), F.lit(cap))


def readable(flat_text: Column) -> Column:
    return F.length(flat_text) >= 80


def is_placeholder(c: Column | str) -> Column:
    """An unfilled page template."""
    return let(F.lower(squeeze(F.coalesce(col(c), F.lit("")))), lambda n: (n == "") | contains_any(n, PLACEHOLDER_MARKERS))
