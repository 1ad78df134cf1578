"""Landed portal payloads -> raw notice records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.fixed import DETAIL_LABELS
from tenderspark.functions.common import blank_to_null, drop_blank, first_match, let, literals, lookup, squeeze, strip
from tenderspark.functions.extract import (ISO_STAMP, content_hash, first_email, first_iso, first_phone, industry_codes,
                                           meeting_flag, office_path, portal_timestamp, primary_contact)
from tenderspark.operators.ranking import first_by, top_per_key
from tenderspark.schemas import RESULT_PAGE

EASTERN, PACIFIC = "America/New_York", "America/Los_Angeles"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def federal_to_raw(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(opportunity, description, documents) -> raw record with its metadata columns; `keep` columns pass through."""
    o = F.col("opportunity")
    ident = F.coalesce(blank_to_null(o["noticeId"]), F.lit("unknown"))
    text = F.coalesce("description", F.lit(""))
    contact = primary_contact(o["pointOfContact"])
    return df.select(
        *keep, F.lit("SAM.gov").alias("source"), ident.alias("external_id"),
        F.coalesce(blank_to_null(o["title"]), ident).alias("title"),
        office_path(o["fullParentPathName"], o["department"]).alias("dept"), text.alias("description"),
        _filled(o["postedDate"]).alias("published_date"), _filled(o["responseDeadLine"]).alias("due_date"),
        _filled(contact["fullName"]).alias("contact_name"), _filled(contact["email"]).alias("contact_email"),
        _filled(contact["phone"]).alias("contact_phone"),
        F.when(F.lower(F.coalesce(o["active"], F.lit(""))) == "yes", "active").otherwise("inactive").alias("status"),
        F.lit(True).alias("is_relevant"), content_hash(ident, text).alias("content_hash"),
        F.coalesce(_filled(o["type"]), _filled(o["baseType"])).alias("event_type"),
        _filled(o["solicitationNumber"]).alias("solicitation_number"), _filled(o["uiLink"]).alias("ui_link"),
        industry_codes(o["naicsCodes"], o["naicsCode"]).alias("naics_codes"),
        _filled(o["classificationCode"]).alias("classification_code"), _filled(o["typeOfSetAside"]).alias("set_aside"),
        _filled(o["typeOfSetAsideDescription"]).alias("set_aside_description"),
        o["placeOfPerformance"].alias("place_of_performance"), o["officeAddress"].alias("office_address"),
        _filled(o["additionalInfoLink"]).alias("additional_info_link"),
        meeting_flag(text).alias("mandatory_bidder_conference"), "documents",
        F.coalesce(o["pointOfContact"], F.array()).alias("all_points_of_contact"))


def union_result_pages(pages: DataFrame, max_per_code: int | None = None) -> DataFrame:
    """Landed search pages (code_idx, offset, body) -> active opportunities, first occurrence of each id.

    `max_per_code` bounds the records taken per search code, as the search itself does.
    """
    parsed = pages.withColumn("_page", F.from_json("body", RESULT_PAGE))
    rows = parsed.select("code_idx", "offset", F.posexplode("_page.opportunitiesData").alias("pos", "opportunity"))
    arrival = [F.col("code_idx"), F.col("offset"), F.col("pos")]
    if max_per_code is not None:
        rows = top_per_key(rows, ["code_idx"], arrival[1:], max_per_code)
    active = rows.filter((F.lower("opportunity.active") == "yes") & (F.coalesce("opportunity.noticeId", F.lit("")) != "")) \
        .withColumn("notice_code", F.col("opportunity.noticeId"))
    return first_by(active, ["notice_code"], arrival).select("notice_code", "code_idx", "offset", "pos", "opportunity")


def last_segment(url: Column) -> Column:
    """Last path segment of a URL without query and fragment."""
    tail = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.regexp_replace(tail, "[?#].*$", "")


def numeric_segment(url: Column) -> Column:
    """Last all-digit path segment, else the last segment, else `unknown`."""
    def pick(parts: Column) -> Column:
        digits = F.filter(parts, lambda p: p.rlike("^[0-9]+$"))
        return F.coalesce(F.try_element_at(digits, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))

    return let(drop_blank(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""), "/")), pick)


SKIPPED_TITLES = ("details", "event id", "format/type:", "published date", "dept:", "event version", "event end date:", "description:")
SKIPPED_STARTS = r"(?i)^(event details|details|event id|format/|event version|description:|unspsc|view event|view vendor)"
LABEL_LINE = (r"(?i)^(event name|title|department|dept|agency|published|posted|due|closing|deadline|contact|buyer name)"
              r"\s*:\s*(.*)$")


def state_text_to_raw(df: DataFrame) -> DataFrame:
    """Event page text (text, url) of the state portal -> raw record.

    A labelled line needs its colon, so `Department of X` is not read as a label.
    """
    ident = F.coalesce(_filled(last_segment(F.col("url"))), F.lit("unknown"))
    base = df.withColumn("external_id", ident).withColumn("_t", strip(F.regexp_replace("text", "\r\n", "\n")))
    base = base.withColumn("_all", F.transform(F.split("_t", "\n"), strip)) \
        .withColumn("_lines", drop_blank(F.col("_all")))
    t, every, lines, ext = F.col("_t"), F.col("_all"), F.col("_lines"), F.col("external_id")

    def after_event(i: Column) -> Column:
        window = F.slice(every, i + 2, F.lit(7))
        fits = F.filter(window, lambda c: (F.length(c) >= 6) & (c != ext) & ~F.array_contains(literals(SKIPPED_TITLES), F.lower(c)))
        return squeeze(F.try_element_at(fits, F.lit(1)))

    heads = F.filter(F.transform(every, lambda ln, i: F.when(
        F.lower(ln).startswith("event :") | (F.lower(ln) == "event id"), i)), lambda i: i.isNotNull())
    title_block = F.try_element_at(F.filter(F.transform(heads, after_event), lambda x: x.isNotNull()), F.lit(1))
    own_line = F.try_element_at(F.filter(lines, lambda ln: ln.startswith(F.concat(ext, F.lit(" ")))), F.lit(1))

    labelled = F.filter(F.transform(lines, lambda ln, i: F.struct(
        F.lower(F.regexp_extract(ln, LABEL_LINE, 1)).alias("label"),
        F.coalesce(_filled(strip(F.regexp_extract(ln, LABEL_LINE, 2))), F.try_element_at(lines, (i + 2).cast("int")), F.lit("")).alias("value"),
    )), lambda s: s["label"] != "")

    def last_of(*names: str, read=lambda v: _filled(v)) -> Column:
        hits = F.filter(F.col("_labels"), lambda s: s["label"].isin(*names))
        return F.try_element_at(F.filter(F.transform(hits, lambda s: read(s["value"])), lambda v: v.isNotNull()), F.lit(-1))

    def stamp(v: Column) -> Column:
        return F.coalesce(portal_timestamp(v, PACIFIC, zone_suffix=False, date_only=False), first_iso(v).try_cast("timestamp"))

    def line_after(pattern: str) -> Column:
        return F.coalesce(first_match(t, r"(?im)^" + pattern + r"\s*$\n\s*(.+)$", 1), first_match(t, r"(?im)^" + pattern + r"[ \t]*(.+)$", 1))

    first_line = F.try_element_at(F.filter(lines, lambda ln: (F.length(ln) >= 6) & ~ln.rlike(SKIPPED_STARTS) & (ln != ext)
                                           & ~(F.lower(ln).startswith("event ") & ~F.contains(ln, ext))), F.lit(1))
    isos = F.regexp_extract_all(t, F.lit("(" + ISO_STAMP + ")"), F.lit(1))
    mail = first_email(t)
    before_mail = strip(F.element_at(F.split(F.right(F.left(t, F.position(mail, t) - 1), F.lit(80)), "\n"), -1))
    named_prefix = F.when(F.length(before_mail).between(3, 79) & ~F.lower(before_mail).startswith("phone:")
                          & ~F.contains(F.lower(before_mail), F.lit("information")), before_mail)
    contact = first_match(t, r"(?is)Contact\s+Information\s*\n\s*([^\n]+)", 1)
    contact = F.when(F.lower(strip(contact)) != "phone:", _filled(strip(contact)))
    return base.withColumn("_labels", labelled).select(
        F.lit("Cal eProcure").alias("source"), "external_id",
        F.coalesce(last_of("event name", "title"), title_block, squeeze(own_line), first_line, ext).alias("title"),
        F.coalesce(last_of("department", "agency"), squeeze(first_match(t, r"(?mi)^Dept:\s*\n\s*([^\n]+)", 1)),
                   last_of("dept")).alias("dept"),
        strip(F.left(t, F.lit(2000))).alias("description"),
        F.coalesce(last_of("published", "posted", read=stamp), stamp(line_after(r"Published\s+Date")),
                   F.try_element_at(isos, F.lit(1)).try_cast("timestamp")).alias("published_date"),
        F.coalesce(last_of("due", "closing", "deadline", read=stamp), stamp(line_after(r"Event\s+End\s+Date:")),
                   F.try_element_at(isos, F.lit(2)).try_cast("timestamp")).alias("due_date"),
        F.coalesce(last_of("contact", "buyer name"), contact, named_prefix).alias("contact_name"),
        mail.alias("contact_email"), first_phone(t).alias("contact_phone"), F.lit("active").alias("status"),
        F.lit(True).alias("is_relevant"), content_hash(ext, F.col("text")).alias("content_hash"))


def unlocked(c: Column) -> Column:
    """Squeezed text; null where blank or the `Locked` placeholder."""
    return let(squeeze(c), lambda v: F.when((v != "") & (F.lower(v) != "locked"), v))


def label_to_field(label: Column) -> Column:
    """Field name behind a detail-page label, null where it is not used."""
    return lookup(F.lower(strip(label)), DETAIL_LABELS)


def group_fields_to_raw(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(fields map, url) of the group portal -> raw record; `keep` columns pass through."""
    f = lambda name: F.try_element_at("fields", F.lit(name))
    ident = numeric_segment(F.col("url"))
    text = F.coalesce(unlocked(f("description")), F.lit(""))
    return df.select(
        *keep, F.lit("BidNet Direct").alias("source"), ident.alias("external_id"),
        F.coalesce(unlocked(f("title")), ident).alias("title"), unlocked(f("issuing_organization")).alias("dept"),
        text.alias("description"), portal_timestamp(f("publication_date"), EASTERN).alias("published_date"),
        portal_timestamp(f("closing_date"), EASTERN).alias("due_date"), unlocked(f("contact_name")).alias("contact_name"),
        unlocked(f("contact_email")).alias("contact_email"), unlocked(f("contact_phone")).alias("contact_phone"),
        F.lit("active").alias("status"), F.lit(True).alias("is_relevant"), content_hash(ident, text).alias("content_hash"),
        F.coalesce(unlocked(f("solicitation_type")), F.lit("Solicitation / Bid")).alias("event_type"),
        unlocked(f("solicitation_number")).alias("solicitation_number"), F.col("url").alias("ui_link"),
        unlocked(f("location")).alias("location"), unlocked(f("source")).alias("issuing_source"))
