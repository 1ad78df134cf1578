"""Derived notice fields: short name, statement of work, deliverables, location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.fixed import (ACTION_WORDS, CITIES, GLUE_WORDS, LABEL_EXCLUDES, LABEL_SPEC_HINTS, OBLIGATION_PHRASES,
                               PROJECT_LEAD_PHRASES, QUESTIONNAIRE_MARKERS, SECTION_HEADERS, SUBMISSION_PHRASES)
from tenderspark.functions.common import (blank_to_null, col, contains_any, drop_blank, first_index, head, let, literals, lookup, squeeze,
                                          starts_with_any, strip, take_from, word_count, words)
from tenderspark.functions.text import LINE_END, is_filler, is_pure_admin, paragraph_sentences

MIN_WORDS, MAX_WORDS = 3, 8
UNTITLED = "Untitled RFP"

# --- fixed values: title patterns ------------------------------------------------
CODE_PREFIX = r"^\s*[A-Z0-9]{2,6}-{1,3}\s*"
NUMBER_PREFIX = r"^\s*\d{6,}\s+"
REQUEST_PREFIX = (r"(?i)^\s*(?:request\s+for\s+(?:proposal|quote|quotation|information|offer))(?:\s+\S+)?\s+"
                  r"(?:for|to|on)\s+")
GUARDED_PREFIXES = (
    r"(?i)^\s*(?:RFP|RFQ|RFI|RFO|RFx|IFB)\s+[\w\-\d.#]+\s*[\-—:]?\s*",
    r"^\s*[A-Z]?\d[\w\-/.]{4,}\s*[\-—:|]\s*",
    r"^\s*[A-Z]{2,}(?:\s+\d+)?\s*\|\s*",
    r"(?i)^\s*(?:request\s+for\s+(?:information|proposals?|quote|quotation|offers?)|combined\s+synopsis(?:/solicitation)?|"
    r"notice\s+of\s+intent(?:\s+to\s+sole\s+source)?|sources?\s+sought|sole\s+source\s+notice|special\s+notice|"
    r"draft\s+sf\d+)\s*[-—:]?\s*",
)
ID_PARENS = (r"(?i)\s*\((?:[^)]*(?:solicitation|amendment|notice|modification)[^)]*|[A-Z0-9_]*[\-_]\S*[\d][^)]*|"
             r"[A-Z0-9]{2,}[\-_]\d[^)]*|\s*[\d][\d\-_/.\s]*\s*)\)")
NUMBER_TAIL = r"(?i)\s*\(?(?:RFP|RFQ|RFI|RFx|IFB|RFO)\s*(?:number|no|#)?\s*:?\s*\S*\)?\s*$"
REFERENCE_TAIL = r"(?i)\s*(?:reference|ref)\s*#?\s*\S*\s*$"
TAIL_TAGS = (
    r"new\s+action|intent\s+to\s+sole\s+source|sole\s+source\s+notice|sole\s+source|amendment(?:\s+\d+)?|"
    r"modification(?:\s+\d+)?|addendum(?:\s+\d+)?|errata|sources?\s+sought(?:\s+notice)?|presolicitation|pre-solicitation|"
    r"combined\s+synopsis(?:/solicitation)?|special\s+notice|draft\s+sf\d+|"
    r"request\s+for\s+(?:information|proposal|quote|quotation|offer|task\s+execution\s+plan)|rfp|rfq|rfi|rfo|ifb")
# Tags and separators at the end, however many in a row.
ALL_TAILS = r"(?i)(?:\s+(?:" + TAIL_TAGS + r")\s*|[:\-—–|/\s])+$"
ACRONYM_PARENS = r"\s*\(\s*[A-Z0-9]{2,8}\s*\)"

# --- fixed values: list and bullet patterns ----------------------------------------
BULLET_ITEM = r"^\s*(?:[-*•]|\d+[.)])\s+(.{10,})$"
ITEM_NOISE = r"^[\s\-\*•\d\.\)\(\:]+|[\s:.;]+$"
NOT_APPLICABLE = r"(?i)[–—\-:]\s*N/?A\s*$"
CAPS_HEADER = r"^[A-Z][A-Z0-9 ,/&-]{4,}\s*:?\s*$"
LIST_LEAD = (r"(?i)(?:supports?|includes?|including|provides?|will\s+provide|shall\s+provide|such\s+as|"
             r"consist(?:s|ing)?\s+of|covers?)\s+([^.]+)")
LIST_VERBS = {"supports": "Support", "support": "Support", "provides": "Provide", "provide": "Provide", "shall": "Provide",
              "will": "Provide", "covers": "Cover", "cover": "Cover"}
FRAGMENT_STARTS = ("including ", "etc", "every other ", "but not limited to", "limited to")
VERB_STARTS = ("check ", "compare ", "research ", "purchase ", "review ", "monitor ", "calibrate ", "repair ")
PROVIDE_STARTS = ("provide", "deliver", "supply", "install", "perform", "furnish")
GENERIC_ITEMS = ("Execute scope of work described in the {} solicitation",
                 "Deliver milestones, status reporting, and acceptance documentation",
                 "Provide final handoff and post-deployment support per RFP terms")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), c.substr(F.lit(2), F.length(c)))


def short_name(title: Column | str, dept: Column | str) -> Column:
    """Project name of three to eight words out of the title."""
    given = F.coalesce(F.nullif(col(dept), F.lit("")), F.lit(UNTITLED))

    def guarded(base: Column, pattern: str) -> Column:
        return let(F.regexp_replace(base, pattern, ""), lambda s: F.when(word_count(s) >= MIN_WORDS, s).otherwise(base))

    def cap(base: Column) -> Column:
        short = squeeze(F.regexp_replace(base, ACRONYM_PARENS, ""))
        return F.when(word_count(base) <= MAX_WORDS, base).otherwise(F.array_join(head(words(short), MAX_WORDS), " "))

    def pad(base: Column) -> Column:
        office = strip(F.split(F.coalesce(col(dept), F.lit("")), r"\.")[0])
        plain = F.concat(base, F.lit(" Project"))
        named = F.concat(base, F.lit(" ("), office, F.lit(")"))
        fits = word_count(base) + word_count(office) <= MAX_WORDS
        use_office = (office != "") & ~F.contains(F.lower(base), F.lower(office)) & fits & (word_count(named) >= MIN_WORDS)
        return F.when((base == "") | (word_count(base) >= MIN_WORDS), base).when(use_office, named).otherwise(plain)

    base = strip(F.coalesce(col(title), F.lit("")))
    for pattern in (CODE_PREFIX, NUMBER_PREFIX, REQUEST_PREFIX):
        base = F.regexp_replace(base, pattern, "")
    for pattern in GUARDED_PREFIXES:
        base = let(base, lambda b, p=pattern: guarded(b, p))
    for pattern in (ID_PARENS, NUMBER_TAIL, REFERENCE_TAIL):
        base = F.regexp_replace(base, pattern, "")
    base = squeeze(F.regexp_replace(base, ALL_TAILS, ""))
    name = let(let(base, cap), lambda b: F.coalesce(blank_to_null(pad(b)), given))
    return F.when(strip(F.coalesce(col(title), F.lit(""))) == "", given).otherwise(name)


def commodity_phrases(descriptions: Column) -> Column:
    """Distinct noun phrases out of commodity descriptions: the most specific part, spelled out."""
    def phrase(d: Column) -> Column:
        part = F.coalesce(F.try_element_at(drop_blank(F.transform(F.split(d, " - "), strip)), F.lit(-1)), F.lit(""))
        for pattern, word in ((r"(?i)\bsrvcs?\b", "services"), (r"(?i)\bmaint\b", "maintenance"), (r"(?i)\bmgmt\b", "management")):
            part = F.regexp_replace(part, pattern, word)
        return F.btrim(F.regexp_replace(part, r"\s+", " "), F.lit(" -"))

    usable = F.filter(descriptions, lambda d: d.isNotNull() & (strip(d) != "") & ~F.contains(d, F.lit("<")))
    phrases = F.filter(F.transform(usable, phrase), lambda p: F.length(p) >= 6)
    first = let(phrases, lambda ps: let(F.transform(ps, lambda p: F.lower(p)), lambda low: F.filter(
        ps, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)))
    return F.transform(first, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), p.substr(F.lit(2), F.length(p))))


def metadata_sentence(name: Column, dept: Column, event_type: Column, solicitation: Column) -> Column:
    """One sentence out of the header fields."""
    office = strip(F.element_at(F.split(strip(F.coalesce(dept, F.lit(""))), r"\."), -1))
    number = strip(F.coalesce(solicitation, F.lit("")))
    kind = strip(F.coalesce(F.nullif(event_type, F.lit("")), F.lit("Solicitation")))
    parts = F.array(F.concat(kind, F.lit(" for "), name),
                    F.when(number != "", F.concat(F.lit("(solicitation "), number, F.lit(")"))),
                    F.when(office != "", F.concat(F.lit("issued by "), office)))
    return F.concat(strip(F.array_join(parts, " ")), F.lit("."))


def work_sentences(description: Column) -> Column:
    """The first twelve substantive sentences."""
    return head(F.filter(paragraph_sentences(description), lambda s: (F.length(s) >= 25) & ~is_filler(s)), 12)


def lead_summary(found: Column, limit: int = 900) -> Column:
    """Three to four sentences from the first project-defining one, within `limit` characters."""
    def build(ss: Column) -> Column:
        lead = F.coalesce(first_index(ss, lambda s: contains_any(F.lower(s), PROJECT_LEAD_PHRASES)), F.lit(0))

        def filled(parts: Column) -> Column:
            earlier = F.array_distinct(F.filter(F.slice(ss, 1, lead), lambda s: ~F.array_contains(parts, s)))
            padded = F.concat(parts, F.slice(earlier, F.lit(1), F.lit(3) - F.size(parts)))
            return F.when(F.size(parts) < 3, padded).otherwise(parts)

        return let(take_from(ss, lead, 4), filled)

    def trim_to(parts: Column) -> Column:
        joined = lambda n: F.array_join(F.slice(parts, F.lit(1), n), " ")
        sizes = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: (n == 1) | (F.length(joined(n)) <= limit))
        return F.when(F.size(parts) == 0, "").otherwise(strip(joined(F.array_max(sizes))))

    return let(let(found, build), trim_to)


def statement_of_work(df: DataFrame, name: Column | str = "name", out: str = "statement_of_work", limit: int = 900) -> DataFrame:
    """Overview of the work from description, codes or header fields.

    Needs description, title, dept, event_type, solicitation_number and code_descriptions.
    """
    desc = strip(F.coalesce("description", F.lit("")))
    fallback = metadata_sentence(col(name), F.col("dept"), F.col("event_type"), F.col("solicitation_number"))

    def by_codes(summary: Column) -> Column:
        made = let(commodity_phrases(F.col("code_descriptions")), lambda p: F.when(F.size(p) > 0, F.concat(
            F.lit("Provide "), F.array_join(head(p, 3), ", "), F.lit(" in support of the "), col(name), F.lit(" engagement."))))
        return F.when(F.length(summary) < 60, F.coalesce(made, summary)).otherwise(summary)

    def checked(summary: Column) -> Column:
        return F.when((summary == "") | is_pure_admin(summary), fallback).otherwise(summary)

    said = let(desc, lambda d: F.when(d != "", lead_summary(work_sentences(d), limit)).otherwise(""))
    summary = let(let(said, by_codes), checked)
    return df.withColumn(out, F.rtrim(F.left(summary, F.lit(limit))))


def normalize_item(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, ITEM_NOISE, ""))


def is_real_item(item: Column) -> Column:
    """A bullet that reads like a task, not a heading or a form label."""
    low = F.lower(item)
    shape = (F.length(item).between(25, 280) & ~item.rlike(NOT_APPLICABLE) & (low != "n/a") & ~low.endswith(" n/a")
             & ~contains_any(low, SUBMISSION_PHRASES))

    def language(ts: Column) -> Column:
        n = F.size(ts)
        caps = F.size(F.filter(ts, lambda t: (F.length(t) >= 2) & (F.upper(t) == t)))
        titled = F.size(F.filter(ts, lambda t: t.rlike("^[A-Z][^A-Z]*[a-z][^A-Z]*$")))
        has = lambda ws: F.arrays_overlap(F.transform(ts, lambda t: F.lower(t)), literals(ws))
        return ((n >= 5) & (caps <= n * 0.35) & (has(ACTION_WORDS) | has(GLUE_WORDS))
                & ((titled <= n * 0.75) | has(ACTION_WORDS)))

    return shape & let(F.regexp_extract_all(item, F.lit(r"[A-Za-z][A-Za-z\-/']*"), F.lit(0)), language)


def bulleted_items(c: Column | str) -> Column:
    """Distinct real bullet and numbered items."""
    lines = F.filter(F.split(col(c), LINE_END), lambda ln: ln.rlike(BULLET_ITEM))
    items = F.transform(lines, lambda ln: normalize_item(F.regexp_extract(ln, BULLET_ITEM, 1)))
    return F.array_distinct(F.filter(items, is_real_item))


def section_items(c: Column | str) -> Column:
    """Items under the first deliverables-style header that has two real ones."""
    header = r"(?i)^\s*(?:" + "|".join(SECTION_HEADERS) + r")\s*:?\s*$"
    start = F.struct(F.lit(0).alias("blanks"), F.lit(False).alias("stop"), _strings().alias("out"))

    def step(acc: Column, line: Column) -> Column:
        text = strip(line)
        blanks = F.when(text == "", acc["blanks"] + 1).otherwise(0)
        ends = ((text == "") & (blanks >= 2) & (F.size(acc["out"]) > 0)) | ((text != "") & text.rlike(CAPS_HEADER))
        item = normalize_item(F.when(line.rlike(BULLET_ITEM), F.regexp_extract(line, BULLET_ITEM, 1)).otherwise(text))
        grown = F.when((text == "") | ends, acc["out"]).otherwise(F.concat(acc["out"], F.array(item)))
        stop = ends | (F.size(grown) >= 8)
        return F.when(acc["stop"], acc).otherwise(F.struct(blanks.alias("blanks"), stop.alias("stop"), grown.alias("out")))

    def sections(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda ln, i: F.when(ln.rlike(header), i)), lambda i: i.isNotNull())
        found = F.transform(heads, lambda i: F.filter(F.aggregate(
            F.slice(lines, i + 2, F.size(lines)), start, step, lambda acc: acc["out"]), is_real_item))
        return F.coalesce(F.try_element_at(F.filter(found, lambda s: F.size(s) >= 2), F.lit(1)), _strings())

    return let(F.split(col(c), LINE_END), sections)


def obligation_sentences(c: Column | str) -> Column:
    """The first five distinct sentences that oblige the contractor to something."""
    def obliges(s: Column) -> Column:
        return let(F.lower(s), lambda low: contains_any(low, OBLIGATION_PHRASES)
                   & ~contains_any(low, SUBMISSION_PHRASES + QUESTIONNAIRE_MARKERS + ("?",)))

    kept = F.transform(F.filter(paragraph_sentences(col(c)), obliges), normalize_item)
    return head(F.array_distinct(F.filter(kept, lambda s: F.length(s).between(20, 280))), 5)


def inline_list_items(c: Column | str) -> Column:
    """Items of the first comma list in prose that yields at least three good ones."""
    def usable(match: Column, chunk: Column) -> Column:
        low = F.lower(chunk)
        return ((F.length(chunk) - F.length(F.replace(chunk, F.lit(","), F.lit(""))) >= 2)
                & ~contains_any(low, QUESTIONNAIRE_MARKERS[4:] + ("if yes", "if no") + QUESTIONNAIRE_MARKERS[2:4])
                & ~F.contains(low, F.lit("but not limited to")) & ~F.contains(F.lower(match), F.lit("such as"))
                & ~F.contains(chunk, F.lit("?")))

    def part(p: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(strip(p), "[.;:]+$", ""), r"(?i)^(?:and|or|the)\s+", ""))

    def good(p: Column) -> Column:
        low = F.lower(p)
        return (F.length(p).between(18, 120) & ~starts_with_any(low, FRAGMENT_STARTS + VERB_STARTS)
                & (F.regexp_count(p, F.lit("[A-Za-z]+")) >= 2))

    def first_of(ps: Column) -> Column:
        return let(F.transform(ps, lambda p: F.lower(p)), lambda low: F.filter(ps, lambda p, i: F.array_position(low, F.lower(p)) == i + 1))

    def prefix(match: Column) -> Column:
        verb = F.lower(F.regexp_extract(match, r"^(\S+)", 1))
        return F.coalesce(lookup(verb, LIST_VERBS.items()), F.lit("Deliver"))

    start = F.struct(_strings().alias("seen"), _strings().alias("out"))

    def step(acc: Column, match: Column) -> Column:
        chunk = strip(F.regexp_extract(match, LIST_LEAD, 1))
        fresh = first_of(F.filter(F.filter(F.transform(F.split(chunk, ","), part), good),
                                  lambda p: ~F.array_contains(acc["seen"], F.lower(p))))

        def take(accepted: Column) -> Column:
            items = F.transform(head(accepted, 4), lambda p: F.concat(prefix(match), F.lit(" "), _lower_first(p)))
            return F.struct(F.concat(acc["seen"], F.transform(accepted, lambda p: F.lower(p))).alias("seen"),
                            F.when(F.size(accepted) >= 3, items).otherwise(_strings()).alias("out"))

        return F.when((F.size(acc["out"]) > 0) | ~usable(match, chunk), acc).otherwise(let(fresh, take))

    matches = F.regexp_extract_all(col(c), F.lit(LIST_LEAD), F.lit(0))
    return F.aggregate(matches, start, step, lambda acc: acc["out"])


def code_items(descriptions: Column) -> Column:
    """Up to four `Provide ...` items out of commodity descriptions."""
    phrases = F.transform(head(commodity_phrases(descriptions), 4), lambda p: F.regexp_replace(p, r"\.+$", ""))
    return F.transform(phrases, lambda p: F.when(starts_with_any(F.lower(p), PROVIDE_STARTS), p)
                       .otherwise(F.concat(F.lit("Provide "), _lower_first(p))))


def label_items(labels: Column, primary: Column | None = None) -> Column:
    """Up to three items out of attachment labels; a label without a spec hint counts only as the first.

    `primary` is an optional array of flags that mark the main specification.
    """
    pairs = F.arrays_zip(labels.alias("label"), (primary if primary is not None else F.transform(labels, lambda x: F.lit(False))).alias("main"))
    named = F.transform(pairs, lambda p: F.struct(strip(F.coalesce(p["label"], F.lit(""))).alias("label"), p["main"].alias("main")))

    def step(out: Column, p: Column) -> Column:
        low = F.lower(p["label"])
        spec = F.coalesce(p["main"], F.lit(False)) | contains_any(low, LABEL_SPEC_HINTS)
        nice = squeeze(F.regexp_replace(F.regexp_replace(p["label"], r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-]+", " "))
        keep = (p["label"] != "") & ~contains_any(low, LABEL_EXCLUDES) & (spec | (F.size(out) == 0)) & (nice != "") & (F.size(out) < 3)
        return F.when(keep, F.concat(out, F.array(F.concat(F.lit("Address requirements in '"), nice, F.lit("'"))))).otherwise(out)

    return F.aggregate(named, _strings(), step)


def deliverables(df: DataFrame, name: Column | str = "name", out: str = "deliverables") -> DataFrame:
    """The first extractor with two items or more, at most four of them, else three generic lines."""
    desc = strip(F.coalesce("description", F.lit("")))

    def enough(items: Column) -> Column:
        sized = F.filter(items, lambda i: (F.length(i) > 10) & (F.length(i) < 280))
        return let(sized, lambda s: F.when(F.size(s) >= 2, head(s, 4)))

    def short(items: Column) -> Column:
        return let(items, lambda s: F.when(F.size(s) >= 2, head(s, 4)))

    generic = F.array(F.concat(F.lit(GENERIC_ITEMS[0].split("{}")[0]), col(name), F.lit(GENERIC_ITEMS[0].split("{}")[1])),
                      F.lit(GENERIC_ITEMS[1]), F.lit(GENERIC_ITEMS[2]))
    tiers = (bulleted_items, section_items, obligation_sentences, inline_list_items)
    text_tiers = let(desc, lambda d: F.when(d != "", F.coalesce(*[enough(fn(d)) for fn in tiers])))
    return df.withColumn(out, F.coalesce(text_tiers, short(code_items(F.col("code_descriptions"))), short(label_items(F.col("labels"))), generic))


def city_in_text(text: Column) -> Column:
    """City followed by the state, else any city named; ties go to the first in the alphabet."""
    def named(t: Column) -> Column:
        def of(held: Column) -> Column:
            with_state = F.filter(held, lambda c: F.rlike(t, F.concat(F.lit(r"\b"), c, F.lit(r"\s*,\s*(?:California|CA)\b"))))
            alone = F.filter(held, lambda c: F.rlike(t, F.concat(F.lit(r"\b"), c, F.lit(r"\b"))))
            return F.coalesce(F.array_min(with_state), F.array_min(alone))

        # Most texts hold no city, which one scan tells.
        return F.when(contains_any(t, CITIES), let(F.filter(literals(CITIES), lambda c: F.contains(t, c)), of))

    return let(text, named)


def detect_location(df: DataFrame) -> DataFrame:
    """Adds location and location_level from meeting_location, description, then title and name."""
    address = F.coalesce(F.col("meeting_location"), F.lit(""))
    part = F.try_element_at(F.filter(F.transform(F.split(address, ","), strip), lambda p: F.array_contains(literals(CITIES), p)), F.lit(1))
    heading = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))
    city = F.coalesce(part, city_in_text(address), city_in_text(F.col("description")), city_in_text(heading))
    return df.withColumn("location", city) \
        .withColumn("location_level", F.when(F.col("location").isNotNull(), "city").otherwise("state")) \
        .withColumn("location", F.coalesce("location", F.lit("California")))
