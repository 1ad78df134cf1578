"""Landed payloads and pages, over the whole tables."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.catalog.tables import TABLES
from tenderspark.schemas import OPPORTUNITY
from tenderspark.session import scratch_path
from tenderspark.sources import pages as pg
from tenderspark.sources import portals as po
from tenderspark.operators.maintenance import ingest_status
from tenderspark.sources.raw import read_raw, write_processed
from tenderspark.streaming.intake import stream_intake

BASE = "https://portal.example.org/"

_GRID = """'<table><tbody class="row clickable"><tr><td data-if-label="tdEventId"> 00' || lpad(cast(page_id as string), 6, '0') || ' </td><td data-if-label="tdEventName"><b>Grid</b> &amp; job ' || cast(page_id as string) || '</td></tr>'
 || '<tr><td data-if-label="tdEventId">12</td><td data-if-label="tdEventName">Short</td></tr></tbody></table>'"""
TABLES["listing_pages"] = f"""select page_id, case page_id % 3 when 0 then html || {_GRID} when 1 then replace(html, 'href="/', 'href="/event/4300/') else replace(html, 'href="/', 'href="view?auc_id=') || {_GRID} end as html from {{pages}}"""
TABLES["code_pages"] = """select page_id, html || '<table><tr><td data-if-label="unspscClassification">' || cast(43211500 + page_id % 7 as string) || '</td><td data-if-label="unspscDescription">Computer <i>servers</i> ' || cast(page_id % 7 as string) || '</td></tr>'
 || '<tr><td data-if-label="unspscClassification">4321</td><td data-if-label="unspscDescription">too short</td></tr></table>'
 || case when page_id % 2 = 0 then '<script>var s = ' || chr(123) || '"CaptureResults": ' || chr(123) || '"unspscCodeBody": [' || chr(123) || '"Children": ' || chr(123) || '"unspscClassification": [' || chr(123) || '"Properties": ' || chr(123) || '"text": " 8111-' || lpad(cast(page_id % 9000 as string), 4, '0') || '"'
 || chr(125) || chr(125) || '], "unspscDescription": [' || chr(123) || '"Properties": ' || chr(123) || '"text": "Service ' || cast(page_id as string) || '"' || chr(125) || chr(125) || ']' || chr(125) || chr(125) || ']' || chr(125) || chr(125) || ';</script>' else '' end as html from {pages}"""
TABLES["opportunities"] = """select o.o_orderkey as seq, chr(123) || '"noticeId": "' || case when o.o_orderkey % 50 = 0 then '' else 'F' || cast(o.o_orderkey as string) end || '", "title": "' || case when o.o_orderkey % 4 = 0 then ' ' else ' Lot ' || cast(o.o_orderkey as string) end
 || '", "fullParentPathName": "' || case when o.o_orderkey % 3 = 0 then '' else 'DEPT.' || o.o_orderpriority end || '", "department": "Dept ' || cast(o.o_custkey as string) || '", "postedDate": "2026-01-01", "responseDeadLine": '
 || case when o.o_orderkey % 5 = 0 then 'null' else '"2026-02-01T10:00:00-05:00"' end || ', "active": "' || case when o.o_orderstatus = 'O' then 'Yes' else 'No' end || '", "type": "' || case when o.o_orderkey % 2 = 0 then 'RFI' else '' end || '", "baseType": "Base", "naicsCodes": ["541511", " 541512"], "naicsCode": "'
 || cast(541511 + o.o_orderkey % 4 as string) || '", "typeOfSetAside": "SBA", "pointOfContact": [' || chr(123) || '"type": "secondary", "fullName": "S", "email": "s@x.org"' || chr(125) || case when o.o_orderkey % 2 = 0 then ', ' || chr(123) || '"type": "primary", "fullName": "P' || cast(o.o_custkey as string) || '", "phone": "1"' || chr(125) else '' end || ']' || chr(125) as body,
 d.text as description from {orders} o left join {documents} d on o.o_orderkey = d.doc_id"""
TABLES["group_fields"] = """select o.o_orderkey as seq, case when o.o_orderkey % 6 = 0 then '' else 'https://g.example.org/solicitations/statewide/' || cast(4440000 + o.o_orderkey as string) || '/abstract?x=1/2' end as url,
 case when o.o_orderkey % 3 = 0 then 'Locked' else '  Bid  ' || cast(o.o_orderkey as string) end as title, case when o.o_orderkey % 4 = 0 then ' LOCKED ' else 'Org ' || o.o_orderpriority end as org,
 '05/2' || cast(o.o_orderkey % 10 as string) || '/2026 03:02 PM EDT' as published, case when o.o_orderkey % 2 = 0 then '09/01/2026' else 'soon' end as closing, d.text as description from {orders} o left join {documents} d on o.o_orderkey = d.doc_id"""


@query("federal_records", """select seq, external_id, title, dept, published_date, due_date, contact_name, contact_email, contact_phone, status, event_type, naics_codes, set_aside,
 'v1-' || external_id || '-' || substr(sha256(external_id || chr(10) || substr(coalesce(description, ''), 1, 8000)), 1, 12) as content_hash from (
 select o_orderkey as seq, case when o_orderkey % 50 = 0 then 'unknown' else 'F' || o_orderkey end as external_id, case when o_orderkey % 4 = 0 then case when o_orderkey % 50 = 0 then 'unknown' else 'F' || o_orderkey end else 'Lot ' || o_orderkey end as title,
 case when o_orderkey % 3 = 0 then 'Dept ' || o_custkey else 'DEPT.' || o_orderpriority end as dept, '2026-01-01' as published_date, case when o_orderkey % 5 <> 0 then '2026-02-01T10:00:00-05:00' end as due_date,
 case when o_orderkey % 2 = 0 then 'P' || o_custkey else 'S' end as contact_name, case when o_orderkey % 2 = 1 then 's@x.org' end as contact_email, case when o_orderkey % 2 = 0 then '1' end as contact_phone,
 case when o_orderstatus = 'O' then 'active' else 'inactive' end as status, case when o_orderkey % 2 = 0 then 'RFI' else 'Base' end as event_type, case when o_orderkey % 4 < 2 then '541511,541512' else '541511,541512,' || (541511 + o_orderkey % 4) end as naics_codes, 'SBA' as set_aside, text as description
 from orders left join documents on o_orderkey = doc_id)""")
def federal_records(t):
    landed = t.opportunities.select("seq", F.from_json("body", OPPORTUNITY).alias("opportunity"), "description",
                                    F.lit(None).cast("array<string>").alias("documents"))
    return po.federal_to_raw(landed, keep=("seq",)).select(
        "seq", "external_id", "title", "dept", "published_date", "due_date", "contact_name", "contact_email", "contact_phone", "status", "event_type",
        F.array_join("naics_codes", ",").alias("naics_codes"), "set_aside", "content_hash")


@query("result_page_union", """select notice_code, code_idx, "offset" from (select 'P' || l_partkey as notice_code, l_orderkey % 5 as code_idx, l_orderkey // 5 as "offset", l_returnflag,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos from lineitem) where l_returnflag = 'A'
 qualify row_number() over (partition by notice_code order by code_idx, "offset", pos) = 1""")
def result_page_union(t):
    return po.union_result_pages(_result_pages(t)).select("notice_code", "code_idx", "offset")


@query("result_page_union_bounded", """select notice_code, code_idx, "offset" from (select * from (select 'P' || l_partkey as notice_code, l_orderkey % 5 as code_idx, l_orderkey // 5 as "offset", l_returnflag,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos from lineitem) qualify row_number() over (partition by code_idx order by "offset", pos) <= 100) where l_returnflag = 'A'
 qualify row_number() over (partition by notice_code order by code_idx, "offset", pos) = 1""")
def result_page_union_bounded(t):
    return po.union_result_pages(_result_pages(t), max_per_code=100).select("notice_code", "code_idx", "offset")


def _result_pages(t):
    """Each order's lines as one landed search page."""
    record = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("noticeId"),
                      F.when(F.col("l_returnflag") == "A", "Yes").otherwise("No").alias("active"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", record.alias("r")))).alias("x"))
    return lines.select((F.col("l_orderkey") % 5).alias("code_idx"), F.floor(F.col("l_orderkey") / 5).alias("offset"), F.to_json(F.struct(
        F.size("x").alias("totalRecords"), F.transform("x", lambda e: e["r"]).alias("opportunitiesData"))).alias("body"))


_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("state_portal_records", """select external_id, title, dept, published_date, due_date, contact_name, contact_email, contact_phone,
 'v1-' || external_id || '-' || substr(sha256(external_id || chr(10) || substr(text, 1, 8000)), 1, 12) as content_hash from (select external_id, text,
 case when length(trim(string_split(text, chr(10))[3])) < 6 then 'Sell Event' else trim(regexp_replace(string_split(text, chr(10))[3], '\\s+', ' ', 'g')) end as title, trim(regexp_replace(string_split(text, chr(10))[7], '\\s+', ' ', 'g')) as dept,
 make_timestamp(2026, 1 + doc_id % 12, 1 + doc_id % 28, 13, 0, 0) at time zone 'America/Los_Angeles' as published_date,
 make_timestamp(2026, 1 + doc_id % 12, 2 + doc_id % 27, 0, 30, 0) at time zone 'America/Los_Angeles' as due_date,
 'Pat Doe ' || doc_id as contact_name, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') as contact_email,
 case when doc_id % 2 = 0 then '760/770-' || lpad(cast(doc_id % 10000 as varchar), 4, '0') else nullif(regexp_extract(text, '(?:\\+?1[-.\\s]?)?(?:\\(\\d{3}\\)\\s*|\\d{3}[-./\\s])\\d{3}[-./\\s]\\d{4}\\b'), '') end as contact_phone from {portal_text})""")
def state_portal_records(t):
    return po.state_text_to_raw(t.portal_text.drop("external_id")).select(
        "external_id", "title", "dept", "published_date", "due_date", "contact_name", "contact_email", "contact_phone", "content_hash")


@query("group_portal_records", """select seq, external_id, coalesce(title, external_id) as title, dept, published_date, due_date, 'v1-' || external_id || '-' || substr(sha256(external_id || chr(10) || substr(coalesce(d, ''), 1, 8000)), 1, 12) as content_hash from (
 select seq, case when url = '' then 'unknown' else cast(4440000 + seq as varchar) end as external_id, case when lower(trim(title)) <> 'locked' then 'Bid ' || seq end as title, case when lower(trim(org)) <> 'locked' then org end as dept,
 make_timestamp(2026, 5, 20 + seq % 10, 15, 2, 0) at time zone 'America/New_York' as published_date, case when seq % 2 = 0 then make_timestamp(2026, 9, 1, 0, 0, 0) at time zone 'America/New_York' end as due_date,
 nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), '') as d from {group_fields})""")
def group_portal_records(t):
    fields = F.create_map(F.lit("title"), "title", F.lit("issuing_organization"), "org", F.lit("publication_date"), "published",
                          F.lit("closing_date"), "closing", F.lit("description"), "description")
    src = t.group_fields.select("seq", "url", fields.alias("fields"))
    return po.group_fields_to_raw(src, keep=("seq",)).select("seq", "external_id", "title", "dept", "published_date", "due_date", "content_hash")


_LINK = "(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']"
_LINKS = f"""(select page_id, name, case when href like '/%' then 'https://portal.example.org' || href else '{BASE}' || href end as url, i from (
 select page_id, i, regexp_extract(a, '{_LINK}', 1) as href, array_to_string(list_filter(list_transform(string_split_regex(dec, '<[^>]+>'), lambda x: {_S.format('x')}), lambda x: x <> ''), ' ') as name from (
  select page_id, a, i, replace(replace(replace(replace(replace(replace(a, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as dec from (
   select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) as a, unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')))) as i from {{listing_pages}})))
 where regexp_matches(lower(href), '/event/|auc_id') and name <> '' qualify row_number() over (partition by page_id, url order by i) = 1)"""
_SEG = "regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '[?#].*$', '')"


@query("listing_links", f"select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as pos, {_SEG} as external_id, name, url from {_LINKS}")
def listing_links(t):
    return pg.listing_links(t.listing_pages, BASE)


@query("listing_rows", f"""select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as pos, {_SEG} as external_id, name, url from {_LINKS}
 union all select page_id, 0, '00' || lpad(cast(page_id as varchar), 6, '0'), 'Grid & job ' || page_id, '{BASE}event/BS3/00' || lpad(cast(page_id as varchar), 6, '0') from pages where page_id not in (select page_id from {_LINKS})
  and page_id in (select page_id from {{listing_pages}} where contains(html, 'tdEventId'))""")
def listing_rows(t):
    return pg.listing(t.listing_pages, BASE, "BS3")


@query("listing_grid", f"select page_id, 0 as pos, '00' || lpad(cast(page_id as varchar), 6, '0') as external_id, 'Grid & job ' || page_id as name, '{BASE}event/BS3/00' || lpad(cast(page_id as varchar), 6, '0') as url from {{listing_pages}} where contains(html, 'tdEventId')")
def listing_grid(t):
    return pg.listing_grid(t.listing_pages, BASE, "BS3")


@query("page_commodity_codes", """select page_id, 0 as pos, cast(43211500 + page_id % 7 as varchar) as code, 'Computer servers ' || page_id % 7 as description from pages
 union all select page_id, 1, '8111' || lpad(cast(page_id % 9000 as varchar), 4, '0'), 'Service ' || page_id from pages where page_id % 2 = 0""")
def page_commodity_codes(t):
    return pg.page_codes(t.code_pages)


@query("processed_files", "select source, external_id, title, name, status, notice_id from {notices}")
def processed_files(t):
    path = scratch_path(t.spark, "processed")
    write_processed(t.notices.select("notice_id", "status", "name", "title", "external_id", "source"), path)
    return t.spark.read.parquet(path).select("source", "external_id", "title", "name", "status", "notice_id")


def _raw_files(t, name):
    """Land every document as JSON notices with keys that no schema lists, one broken record among them per source file."""
    path = scratch_path(t.spark, name)
    notice = F.to_json(F.struct(F.lit("Cal eProcure").alias("source"), F.col("external_id"), F.lit("active").alias("status"), F.col("text").alias("description"),
                                F.struct(F.array(F.struct(F.col("url").alias("url"), F.lit("Page").alias("label"))).alias("documents"),
                                         F.struct(F.col("doc_id").alias("seen"), F.lit("no").alias("quiet")).alias("portal_flags")).alias("metadata"),
                                F.concat(F.lit("run "), (F.col("doc_id") % 3).cast("string")).alias("scraper_run"), F.col("doc_id").alias("rank")))
    body = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("broken "), F.col("external_id"))).otherwise(notice)
    t.portal_text.repartition(8, "doc_id").select(body.alias("value")).write.text(path)
    return path


_LANDED = "(select external_id, text, url, doc_id % 50 = 7 as broken from {portal_text})"


@query("raw_files_accounting", f"""select case when broken then 'failed' else 'upserted' end as ingest_status, run, count(*) as n, sum(seen)::bigint as seen
 from (select *, case when not broken then 'run ' || doc_id % 3 end as run, case when not broken then doc_id end as seen from (select *, doc_id % 50 = 7 as broken from {{portal_text}})) group by 1, 2""")
def raw_files_accounting(t):
    """Record-per-line files; unreadable ones are counted, not fatal.  `run` and `seen` come from keys that no schema lists."""
    read = read_raw(t.spark, [_raw_files(t, "raw")], multi_line=False, suffix="txt")
    run, seen = F.get_json_object("extra", "$.scraper_run"), F.get_json_object("metadata_json", "$.portal_flags.seen").cast("long")
    return ingest_status(read).groupBy("ingest_status", run.alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum(seen).alias("seen"))


@query("processed_records_with_unknown_keys", """select external_id, 'run ' || doc_id % 3 as run, doc_id as seen, '["source","external_id","title"]' as first_keys, '["metadata","scraper_run","rank"]' as last_keys
 from {portal_text} where doc_id % 50 <> 7""")
def processed_records_with_unknown_keys(t):
    """Raw files written as processed JSON records and read again: unlisted keys stand at the tail."""
    path = scratch_path(t.spark, "processed-json")
    read = read_raw(t.spark, [_raw_files(t, "raw-json")], multi_line=False, suffix="txt")
    write_processed(read.filter("_corrupt_record is null"), path, "json")
    keys = F.json_object_keys("value")
    flags = F.get_json_object("value", "$.metadata.portal_flags.seen").cast("long")
    return t.spark.read.text(path).select(
        F.get_json_object("value", "$.external_id").alias("external_id"), F.get_json_object("value", "$.scraper_run").alias("run"), flags.alias("seen"),
        F.to_json(F.slice(keys, 1, 3)).alias("first_keys"), F.to_json(F.slice(keys, -3, 3)).alias("last_keys"))


@query("raw_files_streamed", f"select external_id, text as description, url from {_LANDED} where not broken")
def raw_files_streamed(t):
    source, out = _raw_files(t, "raw-stream"), scratch_path(t.spark, "raw-stream-out")

    def keep(batch):
        return batch.filter("external_id is not null").select("external_id", "description", F.col("metadata.documents")[0]["url"].alias("url"))

    stream_intake(t.spark, source, out, scratch_path(t.spark, "raw-stream-checkpoint"), keep, multi_line=False, suffix="txt").awaitTermination()
    return t.spark.read.parquet(out).drop("batch")
