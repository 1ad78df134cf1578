"""Header fields: canonical forms and single-field extraction."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.fixed import ABBREVIATIONS, DEPARTMENT_ALIASES
from tenderspark.functions import extract as ex
from tenderspark.functions import normalize as nz
from tenderspark.operators import departments as dep
from tenderspark.operators.ranking import first_by
from tenderspark.sources.structured import valid_answer, valid_summary


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_ALIASES = "(values " + ", ".join(f"({_q(a)}, {_q(c)})" for a, c in DEPARTMENT_ALIASES) + ") as al(alias, canonical_name)"
_ABBREVS = "map {" + ", ".join(f"{_q(a)}: {_q(c)}" for a, c in ABBREVIATIONS) + "}"
_BY_LOWER = f"(select lower(alias) as la, arg_max(canonical_name, alias) as canonical_name from {_ALIASES} group by 1)"
_EXPAND = f"""array_to_string(list_transform(list_filter(string_split_regex({{0}}, '\\s+'), lambda x: x <> ''), lambda tok:
 case when regexp_matches(tok, '^[A-Za-z][A-Za-z.]*[,;:]?$') and coalesce(am[regexp_extract(tok, '^([A-Za-z][A-Za-z.]*)', 1)], am[rtrim(regexp_extract(tok, '^([A-Za-z][A-Za-z.]*)', 1), '.')]) is not null
 then coalesce(am[regexp_extract(tok, '^([A-Za-z][A-Za-z.]*)', 1)], am[rtrim(regexp_extract(tok, '^([A-Za-z][A-Za-z.]*)', 1), '.')]) || regexp_extract(tok, '([,;:]?)$', 1) else tok end), ' ')"""
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_PHONE_DIGITS = "regexp_replace(contact_phone, '[^0-9]', '', 'g')"


@query("canonical_source", """select notice_id, case when lower(trim(source)) in ('sam', 'sam.gov') then 'sam.gov'
 when lower(trim(source)) in ('cal eprocure', 'caleprocure', 'calprocure') then 'Cal eProcure'
 when lower(trim(source)) in ('planetbids', 'planet bids') then 'PlanetBids'
 when lower(trim(source)) in ('bidnet direct', 'bidnet') then 'BidNet Direct' else 'other' end as source from {raw_records}""")
def canonical_source(t):
    return t.raw_records.select("notice_id", nz.canonical_source("source").alias("source"))


@query("canonical_status", """select notice_id, case when lower(trim(status)) in ('active','closed','cancelled','awarded','amended')
 then lower(trim(status)) else 'active' end as status, coalesce(lower(trim(status)), 'active') as strict_status from {raw_records}""")
def canonical_status(t):
    return t.raw_records.select("notice_id", nz.canonical_status("status").alias("status"),
                                nz.canonical_status("status", strict=True).alias("strict_status"))


@query("canonical_phone", f"""select notice_id, case when length(d) = 10 then d[1:3] || '-' || d[4:6] || '-' || d[7:10]
 when length(d) = 11 and d[1] = '1' then d[2:4] || '-' || d[5:7] || '-' || d[8:11] when d <> '' then '+' || d end as phone
 from (select notice_id, {_PHONE_DIGITS} as d from {{raw_records}})""")
def canonical_phone(t):
    return t.raw_records.select("notice_id", nz.canonical_phone("contact_phone").alias("phone"))


@query("canonical_email", """select notice_id, case when not contains(e, '@') then e else
 array_to_string(string_split(e, '@')[1:-2], '@') || '@' || lower(string_split(e, '@')[-1]) end as email
 from (select notice_id, trim(contact_email) as e from {raw_records})""")
def canonical_email(t):
    return t.raw_records.select("notice_id", nz.canonical_email("contact_email").alias("email"))


@query("title_and_contact", f"select notice_id, {_SQUEEZE.format('title')} as title, nullif(trim(contact_name), '') as contact_name from {{raw_records}}")
def title_and_contact(t):
    return t.raw_records.select("notice_id", nz.clean_title("title").alias("title"), nz.contact_name("contact_name").alias("contact_name"))


@query("expanded_department", f"select notice_id, {_EXPAND.format('dept')} as dept from (select *, {_ABBREVS} as am from {{raw_records}}) where dept is not null")
def expanded_department(t):
    return t.raw_records.filter(F.col("dept").isNotNull()).select("notice_id", nz.expand_abbreviations("dept").alias("dept"))


@query("department_exact", f"""select notice_id, coalesce(a.canonical_name, b.canonical_name, full_name) as canonical
 from (select notice_id, nullif(c, '') as c, nullif({_EXPAND.format('c')}, '') as full_name
   from (select notice_id, {_SQUEEZE.format('dept')} as c, {_ABBREVS} as am from {{raw_records}}))
 left join {_BY_LOWER} a on lower(c) = a.la left join {_BY_LOWER} b on lower(full_name) = b.la""")
def department_exact(t):
    return dep.canonical_department(t.raw_records, dep.alias_table(t.spark), mode="exact").select("notice_id", "canonical")


@query("department_close_alias")
def department_close_alias(t):
    return dep.canonical_department(t.raw_records, dep.alias_table(t.spark)).groupBy("dept", "canonical").count()


@query("department_lookup", f"""select notice_id, coalesce(canonical_name, trim(dept)) as canonical from {{raw_records}} left join {_BY_LOWER} on la = lower(trim(dept))""")
def department_lookup(t):
    return dep.lookup_department(t.raw_records, dep.alias_table(t.spark), "dept").select("notice_id", "canonical")


def _grams(c):
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''),"
            " lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


@query("department_trigram", f"""with n as (select distinct dept from {{raw_records}} where dept is not null),
 ex as (select dept, canonical_name from n join {_BY_LOWER} on la = lower(trim(dept))),
 g as (select dept, {_grams('dept')} as a from n where dept not in (select dept from ex)),
 s as (select dept, canonical_name, alias, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) as sim
   from g, (select *, {_grams('alias')} as b from {_ALIASES})),
 best as (select dept, canonical_name from s where sim > 0.6 qualify row_number() over (partition by dept order by sim desc, canonical_name, alias) = 1)
 select notice_id, coalesce(ex.canonical_name, best.canonical_name, trim(r.dept)) as canonical from {{raw_records}} r left join ex using (dept) left join best using (dept)""")
def department_trigram(t):
    return dep.trigram_department(t.raw_records, dep.alias_table(t.spark)).select("notice_id", "canonical")


@query("alias_seed_append", f"""select alias, canonical_name from {_ALIASES} union all
 select alias, min(canonical_name) from (select trim(client) as alias, 'Client ' || trim(client) as canonical_name from {{past_projects}} where client is not null)
 where alias not in (select alias from {_ALIASES}) group by 1""")
def alias_seed_append(t):
    new = t.past_projects.filter(F.col("client").isNotNull()).select(
        F.trim("client").alias("alias"), F.concat(F.lit("Client "), F.trim("client")).alias("canonical_name"))
    return dep.append_aliases(dep.alias_table(t.spark), new)


@query("safe_identifier", """select notice_id, coalesce(nullif(trim(regexp_replace(notice_code, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'notice') as safe_id from {raw_records}""")
def safe_identifier(t):
    return t.raw_records.select("notice_id", nz.safe_id("notice_code", "notice").alias("safe_id"))


@query("share_link_id", """select notice_id, coalesce(nullif(regexp_extract(url, '/file/d/([^/?]+)', 1), ''), nullif(regexp_extract(url, '[?&]id=([^&]+)', 1), '')) as file_id,
 case when url like 'https://drive.example.com/%' then 'https://drive.example.com/file/d/' || coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]+)', 1), ''), nullif(regexp_extract(url, '/d/([^/?#]+)', 1), '')) || '/preview' end as preview
 from {raw_records}""")
def share_link_id(t):
    return t.raw_records.select("notice_id", nz.share_link_id("url").alias("file_id"), nz.preview_link("url", "drive.example.com").alias("preview"))


@query("content_hash", """select notice_id, 'v1-' || notice_code || '-' || substr(sha256(notice_code || chr(10) || substr(coalesce(description, ''), 1, 8000)), 1, 12) as content_hash from {raw_records}""")
def content_hash(t):
    return t.raw_records.select("notice_id", ex.content_hash(F.col("notice_code"), F.col("description")).alias("content_hash"))


_PARTS = "regexp_extract(stamp, '(?i)(\\d{1,2})/(\\d{1,2})/(\\d{4})(?:\\s+(\\d{1,2}):(\\d{2})\\s*(AM|PM))?(?:\\s*([A-Z]{2,4}))?', "
_STAMP = f"""(select notice_id, try_cast({_PARTS}1) as int) as mo, try_cast({_PARTS}2) as int) as d, try_cast({_PARTS}3) as int) as y,
 coalesce(try_cast({_PARTS}4) as int), 0) as h, coalesce(try_cast({_PARTS}5) as int), 0) as mi, upper({_PARTS}6)) as ap, upper({_PARTS}7)) as z from {{raw_records}})"""
_LOCAL = "make_timestamp(y, mo, d, h + case when ap = 'PM' and h <> 12 then 12 when ap = 'AM' and h = 12 then -12 else 0 end, mi, 0)"


@query("portal_timestamp", f"""select notice_id, case when y is null then null when z in ('PDT', 'PST', 'PT') then {_LOCAL} at time zone 'America/Los_Angeles'
 else {_LOCAL} at time zone 'America/New_York' end as eastern, case when y is not null and ap <> '' then {_LOCAL} at time zone 'America/Los_Angeles' end as pacific from {_STAMP}""")
def portal_timestamp(t):
    return t.raw_records.select(
        "notice_id", ex.portal_timestamp("stamp", "America/New_York").alias("eastern"),
        ex.portal_timestamp("stamp", "America/Los_Angeles", zone_suffix=False, date_only=False).alias("pacific"))


_POSITIONS = "(select doc_id, text, unnest(range(1, length(text) - 6)) as i from {portal_text})"


@query("commodity_codes", f"""select doc_id, array_to_string(list(code order by i), ',') as codes from (
 select doc_id, min(i) as i, substr(text, i, 8) as code from {_POSITIONS}
 where substr(text, i, 8) ~ '^\\d{{8}}$' and not (substr(' ' || text, i, 1) ~ '^\\w') and not (substr(text, i + 8, 1) ~ '^\\w')
 and contains(lower(substr(text, greatest(i - 120, 1), least(i - 1, 120))), 'unspsc')
 and substr(text, i, 8) <> '01012001' and cast(substr(text, i, 8) as int) not between 19000000 and 21000000 group by doc_id, code)
 group by doc_id""".replace("group by doc_id, code)", "group by doc_id, substr(text, i, 8))"))
def commodity_codes(t):
    return t.portal_text.select("doc_id", F.array_join(ex.commodity_codes("text"), ",").alias("codes")).filter("codes <> ''")


@query("industry_code_list", """select notice_id, case when notice_id % 3 = 0 then trim(naics_codes[2]) when list_contains(naics_codes, naics_codes[2]) then naics_codes[1] || ',' || naics_codes[2] end as codes
 from {notices}""")
def industry_code_list(t):
    many = F.when(F.col("notice_id") % 3 != 0, F.col("naics_codes"))
    single = F.concat(F.lit(" "), F.col("naics_codes")[1], F.lit(" "))
    return t.notices.select("notice_id", F.array_join(ex.industry_codes(many, single), ",").alias("codes"))


@query("primary_contact", """select conv_id, coalesce(arg_min(text, turn) filter (role = 'assistant'), arg_min(text, turn)) as contact from {conversations} group by 1""")
def primary_contact(t):
    contacts = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.when(F.col("role") == "assistant", "primary").otherwise("secondary").alias("type"), "text"))).alias("contacts"))
    return contacts.select("conv_id", ex.primary_contact(F.col("contacts"))["text"].alias("contact"))


@query("office_path", "select notice_id, coalesce(nullif(trim(contact_name), ''), nullif(trim(dept), '')) as office from {raw_records}")
def office_path(t):
    return t.raw_records.select("notice_id", ex.office_path(F.col("contact_name"), F.col("dept")).alias("office"))


_MEET = """(select doc_id, lower(text || case doc_id % 4 when 0 then ' A mandatory Site Visit is set. ' when 1 then ' An Industry Day is held.' when 2 then ' Attendance is mandatory.' else '' end) as s from {documents})"""


@query("meeting_flag", f"""select doc_id, ev and ma as required, case when ev then 'description_heuristic' end as detected_by from (select doc_id,
 contains(s, 'bidder conference') or contains(s, 'bidders conference') or contains(s, 'pre-bid conference') or contains(s, 'pre bid conference') or contains(s, 'site visit') or contains(s, 'site walk') or contains(s, 'industry day') as ev,
 contains(s, 'mandatory site visit') or contains(s, 'mandatory bidder') or contains(s, 'mandatory pre-bid') or contains(s, 'mandatory pre bid') or contains(s, 'mandatory industry day') or contains(s, 'attendance is mandatory') or contains(s, 'attendance is required') as ma
 from {_MEET})""")
def meeting_flag(t):
    tail = (F.when(F.col("doc_id") % 4 == 0, " A mandatory Site Visit is set. ").when(F.col("doc_id") % 4 == 1, " An Industry Day is held.")
            .when(F.col("doc_id") % 4 == 2, " Attendance is mandatory.").otherwise(""))
    return t.documents.select("doc_id", ex.meeting_flag(F.concat("text", tail)).alias("m")).select("doc_id", "m.required", "m.detected_by")


@query("first_contact_fields", """select doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), '') as email,
 coalesce(nullif(regexp_extract(text, '(?i)(?:^|\\n)\\s*Phone\\s*:?\\s*(\\d{3}/\\d{3}-\\d{4})\\b', 1), ''),
  nullif(regexp_extract(text, '(?:\\+?1[-.\\s]?)?(?:\\(\\d{3}\\)\\s*|\\d{3}[-./\\s])\\d{3}[-./\\s]\\d{4}\\b'), '')) as phone,
 nullif(regexp_extract(text, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:[+-]\\d{2}:\\d{2}|Z)?'), '') as iso
 from (select doc_id, text || case when doc_id % 2 = 0 then ' on 2026-05-01T10:00:00Z' else '' end as text from {portal_text})""")
def first_contact_fields(t):
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " on 2026-05-01T10:00:00Z").otherwise(""))
    return t.portal_text.select("doc_id", text.alias("text")).select(
        "doc_id", ex.first_email("text").alias("email"), ex.first_phone("text").alias("phone"), ex.first_iso("text").alias("iso"))


@query("relevant_by_commodity", """select p_partkey, regexp_replace(code, '[^0-9]', '', 'g') ~ '^(43|80101507|8111|8116|8311|831216|831217)' as relevant
 from (select p_partkey, cast(43 + p_partkey % 50 as varchar) || '-1' || cast(p_partkey % 3 as varchar) || '1600' as code from part)""")
def relevant_by_commodity(t):
    code = F.concat((43 + F.col("p_partkey") % 50).cast("string"), F.lit("-1"), (F.col("p_partkey") % 3).cast("string"), F.lit("1600"))
    return t.part.select("p_partkey", ex.relevant_by_commodity(F.array(code)).alias("relevant"))


_CLASS = "(select p_partkey, p_name, case when p_partkey % 3 <> 0 then cast(200 + p_partkey % 800 as varchar) || '-05' end as code from part)"


@query("relevant_by_class", f"""select p_partkey, case when code is not null then replace(code, '-', '') ~ '^(204|205|206|207|208|209|725|726|915|920)'
 else lower(p_name || case when p_partkey % 2 = 0 then ' Cloud migration' else '' end) ~ 'cloud|software|server|network' end as relevant from {_CLASS}""")
def relevant_by_class(t):
    code = F.when(F.col("p_partkey") % 3 != 0, F.concat((200 + F.col("p_partkey") % 800).cast("string"), F.lit("-05")))
    title = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Cloud migration").otherwise(""))
    return t.part.select("p_partkey", ex.relevant_by_class(F.filter(F.array(code), lambda x: x.isNotNull()), title, F.lit("")).alias("relevant"))


_LINES = """(select p_brand, p_partkey, case p_partkey % 4 when 0 then '9' || cast(p_size as string) || '-0' || cast(p_partkey % 5 as string) || '  -  ' || p_type || ' ' || p_type
 when 1 then '9' || cast(p_size as string) || ': ' || upper(p_type) when 2 then p_name else '' end as line from part)"""


@query("class_code_rows", f"""select p_brand, code, description from (
 select p_brand, p_partkey, code, case when d <> '' and trim(substr(d, 1, length(d) // 2)) = trim(substr(d, length(d) // 2 + 1)) then trim(substr(d, 1, length(d) // 2)) else d end as description
 from (select p_brand, p_partkey, regexp_extract(l, '^([0-9][0-9-]{{1,12}})\\s*[-:]?\\s*(.*)$', 1) as code, trim(regexp_extract(l, '^([0-9][0-9-]{{1,12}})\\s*[-:]?\\s*(.*)$', 2)) as d
  from (select *, {_SQUEEZE.format('line')} as l from {_LINES}) where l ~ '^[0-9][0-9-]{{1,12}}'))
 qualify row_number() over (partition by p_brand, code, lower(description) order by p_partkey) = 1""")
def class_code_rows(t):
    line = (F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("9"), F.col("p_size").cast("string"), F.lit("-0"), (F.col("p_partkey") % 5).cast("string"), F.lit("  -  "), "p_type", F.lit(" "), "p_type"))
            .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("9"), F.col("p_size").cast("string"), F.lit(": "), F.upper("p_type")))
            .when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise(""))
    rows = t.part.select("p_brand", "p_partkey", ex.class_code_row(line).alias("r")).filter("r is not null") \
        .select("p_brand", "p_partkey", "r.code", "r.description", F.lower("r.description").alias("key"))
    return first_by(rows, ["p_brand", "code", "key"], [F.col("p_partkey")]).select("p_brand", "code", "description")


_REPLY = """(select conv_id, turn, case turn % 5
 when 0 then '```json' || chr(10) || chr(123) || '"description": "' || role || ' ", "statement_of_work": "t' || cast(turn as string) || '"' || chr(125) || chr(10) || '```'
 when 1 then 'Sure: ' || chr(123) || '"description": "d", "statement_of_work": 5' || chr(125) || ' done' when 2 then 'no json'
 when 3 then chr(123) || '"description": "  ", "statement_of_work": "x"' || chr(125) else chr(123) || 'broken' end as reply from {conversations})"""


@query("structured_answer", """select conv_id, turn, trim(j->>'$.description') as description, trim(j->>'$.statement_of_work') as statement_of_work from (
 select conv_id, turn, case when json_valid(b) then b::json end as j from (select conv_id, turn, regexp_extract(reply, '(?s)\\{.*\\}') as b from """
       + _REPLY + """)) where json_type(j, '$.description') = 'VARCHAR' and json_type(j, '$.statement_of_work') = 'VARCHAR'
 and trim(j->>'$.description') <> '' and trim(j->>'$.statement_of_work') <> ''""")
def structured_answer(t):
    replies = t.spark.sql("select * from " + _REPLY, conversations=t.conversations)
    return valid_answer(replies, "reply").filter("valid").select("conv_id", "turn", "answer.description", "answer.statement_of_work")


_FACTS = """'[' || chr(123) || '"label": "l", "detail": "' || role || '", "citation": ' || chr(123) || case when turn % 5 = 4 then '"quot"' else '"quote"' end || ': "q"' || chr(125) || chr(125) || ']'"""
_SUMMARY = f"""(select conv_id, turn, case when turn % 5 = 3 then 'oops' else chr(123) || '"opportunity_posture": "p' || cast(conv_id as string) || '", "opportunity_posture_citations": [], ' || case when turn % 5 = 1 then '' else '"scope_of_work": "w", ' end
 || '"scope_of_work_citations": [' || chr(123) || '"quote": "q"' || chr(125) || '], "critical_deadlines": [], "evaluation_criteria": [' || chr(123) || '"name": "n", "description": "d", "weight_pct": null, "citation": ' || chr(123) || '"quote": "q"' || chr(125) || chr(125)
 || '], "contract_details": ' || {_FACTS} || ', "technical_work_areas": [], "submission_guidance": [], "points_of_contact": []' || chr(125) end as body from {{conversations}})"""


@query("structured_summary", "select conv_id, turn, turn % 5 in (0, 2) as valid, case when turn % 5 in (0, 2) then json_extract_string(body, '$.opportunity_posture') end as posture from " + _SUMMARY)
def structured_summary(t):
    bodies = t.spark.sql("select * from " + _SUMMARY, conversations=t.conversations)
    return valid_summary(bodies, "body").select("conv_id", "turn", "valid", F.when(F.col("valid"), F.col("summary.opportunity_posture")).alias("posture"))
