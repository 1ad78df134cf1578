"""Hand-made rows for the branches the generated tables do not reach."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import derive as dv
from tenderspark.functions import extract as ex
from tenderspark.functions import normalize as nz
from tenderspark.functions import text as tx
from tenderspark.operators import feed
from tenderspark.operators import scoring as sc
from tenderspark.operators import tagging as tg
from tenderspark.sources import pages as pg
from tenderspark.sources import portals as po


def one(spark, column, **values):
    """Value of a column expression over one row of named strings."""
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None or isinstance(v, str) else F.lit(v).alias(k)
                                  for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("url,expected", [
    ("/public/supplier/solicitations/statewide/444042433665/abstract?purchasingGroupId=1", "444042433665"), ("", "unknown"), (None, "unknown"),
    ("https://x.org/a/b", "b")])
def test_group_portal_id(spark, url, expected):
    assert one(spark, po.numeric_segment(F.col("u")), u=url) == expected


@pytest.mark.parametrize("text,expected", [
    ("05/29/2026 03:02 PM EDT", dt.datetime(2026, 5, 29, 19, 2)), ("09/01/2026", dt.datetime(2026, 9, 1, 4, 0)),
    ("12/01/2026 12:00 AM PST", dt.datetime(2026, 12, 1, 8, 0)), ("not a date", None), (None, None), ("13/45/2026", None)])
def test_group_portal_timestamp(spark, text, expected):
    assert one(spark, ex.portal_timestamp("t", "America/New_York"), t=text) == expected


def test_state_portal_timestamp_ignores_suffix(spark):
    assert one(spark, ex.portal_timestamp("t", "America/Los_Angeles", False, False), t="04/23/2026  1:00PM EDT") == dt.datetime(2026, 4, 23, 20, 0)
    assert one(spark, ex.portal_timestamp("t", "America/Los_Angeles", False, False), t="04/23/2026") is None


@pytest.mark.parametrize("codes,title,expected", [
    (["920-05"], "x", True), ([], "Cloud migration project", True), (["910-00"], "Janitorial", False),
    (["918", "952"], "provider network", False)])
def test_class_relevance(spark, codes, title, expected):
    made = F.array(*[F.lit(c) for c in codes]).cast("array<string>")
    assert one(spark, ex.relevant_by_class(made, F.col("t"), F.lit("")), t=title) is expected


def test_commodity_relevance_ignores_description(spark):
    assert one(spark, ex.relevant_by_commodity(F.array("c")), c="51000000") is False
    assert one(spark, ex.relevant_by_commodity(F.array("c")), c="43-23") is True


@pytest.mark.parametrize("text,expected", [
    ("[Event Title] Loading...", True), ("Contact Information [Contact Name]", True), ("  ", True), (None, True),
    ("The department seeks proposals for software.", False)])
def test_placeholder(spark, text, expected):
    assert one(spark, tx.is_placeholder("t"), t=text) is expected


def test_grid_and_code_cells(spark):
    grid = """<table><tbody class="x Clickable"><tr><td data-if-label="tdEventId"> 0000039014 </td><td data-if-label="tdEventName">Alpha</td></tr>
    <tr><td data-if-label="tdEventId">0000039020</td><td data-if-label="tdEventName">Beta</td></tr></tbody></table>""".replace("Clickable", "clickable")
    cells = '<td data-if-label="unspscClassification">43211501</td><td data-if-label="unspscDescription">Computer servers</td>'
    df = spark.createDataFrame([(1, grid + cells)], "page_id int, html string")
    rows = pg.listing(df, "https://p.org/", "BS3").collect()
    assert [(r.external_id, r.name, r.url) for r in rows] == [
        ("0000039014", "Alpha", "https://p.org/event/BS3/0000039014"), ("0000039020", "Beta", "https://p.org/event/BS3/0000039020")]
    assert [(r.code, r.description) for r in pg.page_codes(df).collect()] == [("43211501", "Computer servers")]


@pytest.mark.parametrize("phone,expected", [("(916) 653-8468", "916-653-8468"), ("1-916-653-8468", "916-653-8468"), ("n/a", None), (None, None), ("+44 20", "+4420")])
def test_phone(spark, phone, expected):
    assert one(spark, nz.canonical_phone("p"), p=phone) == expected


def test_source_status_email(spark):
    assert one(spark, nz.canonical_source("s"), s=None) == "other"
    assert one(spark, nz.canonical_source("s"), s=" BidNet ") == "BidNet Direct"
    assert one(spark, nz.canonical_status("s"), s="inactive") == "active"
    assert one(spark, nz.canonical_status("s", strict=True), s="inactive") == "inactive"
    assert one(spark, nz.canonical_email("e"), e=" a@b@HOST.Org ") == "a@b@host.org"
    assert one(spark, nz.canonical_email("e"), e="") is None


@pytest.mark.parametrize("lo,hi,expected", [
    (None, None, "—"), (1250000.0, None, "$1.3M"), (2000000.0, 2000000.0, "$2M"), (850000.0, 1200000.0, "$850K – $1.2M"), (999.0, None, "$999"), (999.6, None, "$1,000")])
def test_amount_text(spark, lo, hi, expected):
    row = spark.createDataFrame([(lo, hi)], "lo double, hi double")
    assert row.select(feed.format_amount(F.col("lo"), F.col("hi"))).first()[0] == expected


@pytest.mark.parametrize("text,expected", [("$1.2M", 1200000.0), ("$850K", 850000.0), ("—", 0.0), ("$850K – $1.2M", None), ("$1,000", 1000.0), ("$850K – $900", 0.0)])
def test_amount_value(spark, text, expected):
    assert one(spark, feed.parse_amount(F.col("t")), t=text) == expected


@pytest.mark.parametrize("title,dept,expected", [
    ("DA10--Civica MultiVue System Support New Action", "X", "Civica MultiVue System Support"),
    ("75350667 Civica MultiVue", "Veterans Affairs", "Civica MultiVue (Veterans Affairs)"),
    ("", "Parks", "Parks"), (None, None, "Untitled RFP")])
def test_short_name(spark, title, dept, expected):
    assert one(spark, dv.short_name("t", "d"), t=title, d=dept) == expected


def test_city_rules(spark):
    assert one(spark, dv.city_in_text(F.col("t")), t="UC Davis Health serves Fresno, CA") == "Fresno"
    assert one(spark, dv.city_in_text(F.col("t")), t="Oakland and Burbank") == "Burbank"
    assert one(spark, dv.city_in_text(F.col("t")), t="Oaklander") is None


def test_addenda_and_admin_lead(spark):
    text = "1/8/26\nThis is Addendum 4. Dates.\n\n1/9/26\nPlain line.\nMore.\n\n1/7/26 - Addendum 3 has been posted.\nKept."
    assert one(spark, tx.strip_addenda("t"), t=text) == "Plain line.\nMore.\n\nKept."
    lead = "This is a combined synopsis of it. The work is real. Notice of intent stays."
    assert one(spark, tx.strip_admin_lead("t"), t=lead) == "The work is real. Notice of intent stays."
    assert one(spark, tx.strip_admin_lead("t"), t="Disclaimer: none.") is None


def test_commodity_codes_need_marker(spark):
    assert one(spark, ex.commodity_codes("t"), t="12345678 UNSPSC 43211501 01012001 20260514 43211501 81111500") == ["43211501", "81111500"]
    assert one(spark, ex.commodity_codes("t"), t="unspsc " + "x" * 130 + " 43211501") == []


def scored(spark, ps):
    arr = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(i).alias("pos"), F.lit(f"t{i}").alias("tag")) for i, p in enumerate(ps)])
    return spark.range(1).select(tg.select_tags(arr)).first()[0]


def test_select_tags_bounds(spark):
    assert scored(spark, [.9, .8, .7, .6, .55]) == ["t0", "t1", "t2", "t3"]
    assert scored(spark, [.1, .3, .2]) == ["t1", "t2"]
    assert scored(spark, [.5, .3, .5]) == ["t0", "t2"]


@pytest.mark.parametrize("prefs,state,location,expected", [
    (["Nationwide"], "California", None, (100, False, "Contractor accepts federal / nationwide opportunities.")),
    (["Northern California"], "California", None, (100, False, 'RFP location "california" is part of preferred area "northern california".')),
    (["Reno", " California "], "California", "Fresno", (100, False, 'Preferred location "california" matches RFP location.')),
    (["Lake Tahoe"], None, "Tahoe Basin", (60, False, "Partial location overlap on: tahoe.")),
    (["Nevada", "Oregon"], "California", "Fresno", (0, False, "RFP location (california / fresno) not in contractor's preferred areas (nevada, oregon).")),
    ([" "], "California", None, (0, True, "Skipped: contractor has no preferred locations or RFP has no state/location.")),
    (["Nevada"], None, " ", (0, True, "Skipped: contractor has no preferred locations or RFP has no state/location."))])
def test_geography(spark, prefs, state, location, expected):
    df = spark.createDataFrame([(prefs, state, location)], "p array<string>, s string, l string")
    got = df.select(sc.geography_score(F.col("p"), F.col("s"), F.col("l")).alias("g")).select("g.*").first()
    assert tuple(got) == expected


@pytest.mark.parametrize("dept,client,expected", [
    ("Dept A", "dept a", 100), ("California Department of Justice", "Department of Justice", 70), ("Water Resources Board", "Resources for Water Users", 40), ("Parks", "Roads", 0)])
def test_agency_tier(spark, dept, client, expected):
    assert one(spark, sc.agency_tier(F.col("d"), F.col("c")), d=dept, c=client) == expected


def test_code_matches_first_best(spark):
    df = spark.createDataFrame([(["541511", "236220", "999"], ["541519", "541512", "236115"])], "r array<string>, h array<string>")
    got = df.select(F.explode(sc.code_matches(F.col("r"), F.col("h"))).alias("m")).select("m.*").collect()
    assert [(g.required, g.score, g.held, g.level) for g in got] == [
        ("541511", 0.6, "541519", "industry-group"), ("236220", 0.3, "236115", "sector"), ("999", 0.0, "", "none")]


def test_term_hits_boundaries(spark):
    texts = spark.createDataFrame([(1, "we use c++ and gis-data; 24/7 a.b"), (2, "cc gisx data center ++")], "notice_id int, text string")
    terms = spark.createDataFrame([("c++",), ("gis",), ("gis-data",), ("data center",), ("++",), ("24/7",), ("a.b",), ("a-b",)], "term string")
    got = {(r.notice_id, r.term) for r in sc.term_hits(texts, terms).collect()}
    assert got == {(1, "c++"), (1, "gis"), (1, "gis-data"), (1, "24/7"), (1, "a.b"), (2, "data center"), (2, "++")}


def test_term_hits_equal_the_pattern(spark):
    rng = random.Random(6)
    pieces = ["a", "b", "ab", "1", " ", " ", "-", "(", ")", ".", "++", "é", "\n", "a b"]
    make = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(1, n)))
    texts = [(k, make(25)) for k in range(250)] + [(999, "")]
    terms = sorted({t for t in (make(4).strip() for _ in range(300)) if t})
    got = {(r.notice_id, r.term) for r in sc.term_hits(spark.createDataFrame(texts, "notice_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(k, t) for k, text in texts for t in terms if re.search(f"(?:^|[^a-z0-9]){re.escape(t)}(?:$|[^a-z0-9])", text)}


def test_document_text_keeps_last_anchor(spark):
    text = "Cover\nDescription:\nOld part\n\nScope of Work:\nThe new body."
    assert one(spark, tx.document_text("t"), t=text) == "The new body."
    assert one(spark, tx.document_text("t"), t="Cover\n1.2 Background\nBody text") == "Body text"
