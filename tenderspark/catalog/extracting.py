"""Derived fields over the whole descriptions."""

from pyspark.sql import functions as F

from tenderspark.catalog.cleaning import _AW, _FILLER, _any, _q
from tenderspark.catalog.registry import CHECKS, query
from tenderspark.catalog.tables import TABLES
from tenderspark.fixed import (ACTION_WORDS, CITIES, FILLER_PHRASES, GLUE_WORDS, LABEL_EXCLUDES, LABEL_SPEC_HINTS, OBLIGATION_PHRASES,
                               PROJECT_LEAD_PHRASES, PROJECT_SIGNAL_PHRASES, SECTION_HEADERS, SUBMISSION_PHRASES)
from tenderspark.functions import derive as dv

_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"

TABLES["titles"] = """select d.doc_id, case d.doc_id % 12 when 0 then 'DA10-- ' when 1 then '75350667 ' when 2 then 'Request for Proposal X-1 for ' when 3 then 'RFP 12-A - ' when 4 then 'S25073069 - '
 when 5 then 'VISN 15 | ' when 6 then 'Sources Sought: ' when 7 then 'Notice of Intent - ' else '' end
 || case d.doc_id % 4 when 0 then substr(replace(d.text, chr(10), ' '), 1, 30) when 1 then substr(replace(d.text, chr(10), ' '), 1, 90) when 2 then 'Water' else ' ' || substr(replace(d.text, chr(10), ' '), 1, 12) end
 || case d.doc_id % 9 when 0 then ' (VA-26-00046145)' when 1 then ' (WaterTAP) (USSF)' when 2 then ' New Action - RFI' when 3 then ' Sole Source Notice | Amendment 2 /' when 4 then ' RFP #73040873' when 5 then ' Reference #12' when 6 then ' (amendment of it)' else '' end as title,
 case d.doc_id % 5 when 0 then cast(null as string) when 1 then 'Roads.West' when 2 then 'Department of the Interior Works and of Public Land and Water' else 'Parks Office' end as dept from {documents} d"""


def _rep(expr, pattern, new="''"):
    return f"regexp_replace({expr}, {_q(pattern)}, {new}, 'g')"


def _steps():
    base = _S.format("coalesce(title, '')")
    for p in (dv.CODE_PREFIX, dv.NUMBER_PREFIX, dv.REQUEST_PREFIX):
        base = _rep(base, p)
    sql = f"(select doc_id, dept, title, {base} as b from {{titles}})"
    for p in dv.GUARDED_PREFIXES:
        sql = f"(select doc_id, dept, title, case when len({_WORDS.format('s')}) >= 3 then s else b end as b from (select *, {_rep('b', p)} as s from {sql}))"
    base = "b"
    for p in (dv.ID_PARENS, dv.NUMBER_TAIL, dv.REFERENCE_TAIL):
        base = _rep(base, p)
    sql = f"(select doc_id, dept, title, {_SQ.format(_rep('b', dv.ALL_TAILS))} as b from (select doc_id, dept, title, {base} as b from {sql}))"
    acro = _SQ.format(_rep("b", dv.ACRONYM_PARENS))
    sql = f"(select doc_id, dept, title, case when len({_WORDS.format('b')}) <= 8 then b else array_to_string({_WORDS.format(acro)}[1:8], ' ') end as b, trim(string_split(coalesce(dept, ''), '.')[1]) as o from {sql})"
    return f"""(select doc_id, coalesce(nullif(case when b = '' or len({_WORDS.format('b')}) >= 3 then b
 when o <> '' and not contains(lower(b), lower(o)) and len({_WORDS.format('b')}) + len({_WORDS.format('o')}) <= 8 and len({_WORDS.format("b || ' (' || o || ')'")}) >= 3 then b || ' (' || o || ')' else b || ' Project' end, ''), nullif(dept, ''), 'Untitled RFP') as name from {sql})"""


@query("short_name", "select doc_id, name from " + _steps())
def short_name(t):
    return t.titles.select("doc_id", dv.short_name("title", "dept").alias("name"))


_PHRASE = """(select doc_id, upper(substr(p, 1, 1)) || substr(p, 2) as phrase, i from (select doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_filter(list_transform(string_split(d, ' - '), lambda x: trim(x)), lambda x: x <> '')[-1],
 '(?i)\\bsrvcs?\\b', 'services', 'g'), '(?i)\\bmaint\\b', 'maintenance', 'g'), '(?i)\\bmgmt\\b', 'management', 'g'), '\\s+', ' ', 'g'), ' -') as p from (select doc_id, unnest(code_descriptions) as d, unnest(range(len(code_descriptions))) as i from {descriptions})
 where trim(d) <> '' and not contains(d, '<')) where length(p) >= 6 qualify row_number() over (partition by doc_id, lower(p) order by i) = 1)"""


@query("commodity_items", f"""select doc_id, string_agg(case when regexp_matches(lower(r), '^(provide|deliver|supply|install|perform|furnish)') then r else 'Provide ' || lower(substr(r, 1, 1)) || substr(r, 2) end, '|' order by i) as items
 from (select doc_id, i, rtrim(phrase, '.') as r from {_PHRASE}) group by 1""")
def commodity_items(t):
    return t.descriptions.select("doc_id", F.array_join(dv.code_items(F.col("code_descriptions")), "|").alias("items")).filter("items <> ''")


@query("label_items", f"""select doc_id, string_agg('Address requirements in ''' || nice || '''', '|' order by i) as items from (
 select doc_id, i, {_SQ.format("regexp_replace(regexp_replace(l, '\\.[A-Za-z0-9]{1,5}$', ''), '[_-]+', ' ', 'g')")} as nice, {_any('lower(l)', LABEL_SPEC_HINTS)} as spec, row_number() over (partition by doc_id order by i) as r
 from (select doc_id, unnest(labels) as l, unnest(range(len(labels))) as i from {{descriptions}}) where not {_any('lower(l)', LABEL_EXCLUDES)}) where (spec or r = 1) and nice <> '' group by 1""")
def label_items(t):
    return t.descriptions.select("doc_id", F.array_join(dv.label_items(F.col("labels")), "|").alias("items")).filter("items <> ''")


_ITEM = _SQ.format("regexp_replace({0}, '^[\\s*•\\d.)(:-]+|[\\s:.;]+$', '', 'g')")
_TOK = "regexp_extract_all({0}, '[A-Za-z][A-Za-z/''-]*')"


def _list(ws):
    return "[" + ", ".join(_q(w) for w in ws) + "]"


def _real(x):
    tok = _TOK.format(x)
    low = f"list_transform({tok}, lambda q: lower(q))"
    act, glue = f"list_has_any({low}, {_list(ACTION_WORDS)})", f"list_has_any({low}, {_list(GLUE_WORDS)})"
    return (f"(length({x}) between 25 and 280 and not regexp_matches({x}, '(?i)[–—:-]\\s*N/?A\\s*$') and lower({x}) not like '% n/a' and not {_any(f'lower({x})', SUBMISSION_PHRASES)} and len({tok}) >= 5"
            f" and len(list_filter({tok}, lambda q: length(q) >= 2 and upper(q) = q)) <= len({tok}) * 0.35 and ({act} or {glue})"
            f" and (len(list_filter({tok}, lambda q: regexp_matches(q, '^[A-Z][^A-Z]*[a-z][^A-Z]*$'))) <= len({tok}) * 0.75 or {act}))")


def _uniq(x):
    return f"list_filter({x}, lambda e, j: list_position({x}, e) = j)"


_BI = "^\\s*(?:[-*•]|\\d+[.)])\\s+(.{10,})$"
_LINES = "string_split(coalesce(description, ''), chr(10))"
_BULLETS = f"list_filter(list_transform(list_filter({_LINES}, lambda ln: regexp_matches(ln, '{_BI}')), lambda ln: " + _ITEM.format(f"regexp_extract(ln, '{_BI}', 1)") + f"), lambda it: {_real('it')})"


@query("bulleted_items", f"select doc_id, array_to_string({_uniq('b')}, '|') as items from (select doc_id, {_BULLETS} as b from {{descriptions}})")
def bulleted_items(t):
    return t.descriptions.select("doc_id", F.array_join(dv.bulleted_items(F.coalesce("description", F.lit(""))), "|").alias("items"))


@query("section_items", f"""select doc_id, string_agg(item, '|' order by l) as items from (select doc_id, l, item, count(*) over (partition by doc_id) as n from (
 select doc_id, l, {_ITEM.format(f"case when regexp_matches(ln, '{_BI}') then regexp_extract(ln, '{_BI}', 1) else trim(ln) end")} as item from (
  select *, min(case when l > h and trim(ln) <> '' and regexp_matches(trim(ln), '^[A-Z][A-Z0-9 ,/&-]{{4,}}\\s*:?\\s*$') then l end) over (partition by doc_id) as stop from (
   select *, min(case when regexp_matches(ln, '(?i)^\\s*(?:{'|'.join(SECTION_HEADERS)})\\s*:?\\s*$') then l end) over (partition by doc_id) as h from (
    select doc_id, unnest({_LINES}) as ln, unnest(range(len({_LINES}))) as l from {{descriptions}})))
 where l > h and (stop is null or l < stop) and trim(ln) <> '' qualify row_number() over (partition by doc_id order by l) <= 8) where {_real('item')}) where n >= 2 group by 1""")
def section_items(t):
    return t.descriptions.select("doc_id", F.array_join(dv.section_items(F.coalesce("description", F.lit(""))), "|").alias("items")).filter("items <> ''")


_SENT = """flatten(list_transform(string_split_regex(coalesce(description, ''), '\\n\\s*\\n'), lambda p: list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(p, '\\s+', ' ', 'g')), '([.!?])\\s+([A-Z0-9“"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')))"""
_QUEST = (" if yes", " if no", 'if "yes"', 'if "no"', "draft pws", "encompass the requirement", "more accurate proposal", "technical and functional comments", "please provide your")
_OBL = f"list_filter(list_transform(list_filter({_SENT}, lambda s: {_any('lower(s)', OBLIGATION_PHRASES)} and not {_any('lower(s)', SUBMISSION_PHRASES)} and not {_any('lower(s)', _QUEST)} and not contains(s, '?')), lambda s: " + _ITEM.format("s") + "), lambda s: length(s) between 20 and 280)"


@query("obligation_sentences", f"select doc_id, array_to_string({_uniq('o')}[1:5], '|') as items from (select doc_id, {_OBL} as o from {{descriptions}})")
def obligation_sentences(t):
    return t.descriptions.select("doc_id", F.array_join(dv.obligation_sentences(F.coalesce("description", F.lit(""))), "|").alias("items"))


_LEAD = "(?i)(?:supports?|includes?|including|provides?|will\\s+provide|shall\\s+provide|such\\s+as|consist(?:s|ing)?\\s+of|covers?)\\s+([^.]+)"
_BAD_LIST = ("draft pws", "encompass the requirement", "more accurate proposal", "technical and functional comments", "please provide your",
             "if yes", "if no", 'if "yes"', 'if "no"', "but not limited to", "?")


@query("inline_list_items", f"""select doc_id, string_agg(verb || ' ' || lower(substr(p, 1, 1)) || substr(p, 2), '|' order by i) as items from (select *, min(k) over (partition by doc_id) as k0 from (
 select *, row_number() over (partition by doc_id, k order by i) as r, count(*) over (partition by doc_id, k) as n from (
  select doc_id, k, i, p, case lower(regexp_extract(m, '^\\S+')) when 'supports' then 'Support' when 'support' then 'Support' when 'provides' then 'Provide' when 'provide' then 'Provide'
    when 'shall' then 'Provide' when 'will' then 'Provide' when 'covers' then 'Cover' when 'cover' then 'Cover' else 'Deliver' end as verb from (
   select doc_id, k, m, i, trim(regexp_replace(rtrim(trim(raw, chr(10) || ' '), '.;:'), '(?i)^(?:and|or|the)\\s+', ''), chr(10) || ' ') as p from (
    select doc_id, k, m, unnest(string_split(chunk, ',')) as raw, unnest(range(len(string_split(chunk, ',')))) as i from (
     select doc_id, k, m, regexp_extract(m, '{_LEAD}', 1) as chunk from (select doc_id, unnest(regexp_extract_all(description, '{_LEAD}')) as m, unnest(range(len(regexp_extract_all(description, '{_LEAD}')))) as k from {{descriptions}}))
    where length(chunk) - length(replace(chunk, ',', '')) >= 2 and not {_any('lower(chunk)', _BAD_LIST)} and not contains(lower(m), 'such as')))
  where length(p) between 18 and 120 and not regexp_matches(lower(p), '^(including |etc|every other |but not limited to|limited to|check |compare |research |purchase |review |monitor |calibrate |repair )')
   and len(regexp_extract_all(p, '[A-Za-z]+')) >= 2 qualify row_number() over (partition by doc_id, k, lower(p) order by i) = 1)
 ) where n >= 3) where k = k0 and r <= 4 group by 1""")
def inline_list_items(t):
    return t.descriptions.select("doc_id", F.array_join(dv.inline_list_items(F.coalesce("description", F.lit(""))), "|").alias("items")).filter("items <> ''")


_WORK = f"list_filter({_SENT}, lambda s: length(s) >= 25 and not {_FILLER.format('s')})[1:12]".replace("{{", "{").replace("}}", "}")


@query("work_lead_sentences", f"""select doc_id, array_to_string(case when len(ss) = 0 then [] else ss[coalesce(k, 1):coalesce(k, 1) + 3] end, ' ') as lead from (
 select doc_id, ss, list_position(list_transform(ss, lambda s: {_any('lower(s)', PROJECT_LEAD_PHRASES)}), true) as k from (select doc_id, {_WORK} as ss from {{descriptions}}))""".replace("coalesce(k, 1)", "coalesce(nullif(k, 0), 1)"))
def work_lead_sentences(t):
    ss = dv.work_sentences(F.coalesce("description", F.lit("")))
    def lead(found):
        at = F.coalesce(dv.first_index(found, lambda s: dv.contains_any(F.lower(s), PROJECT_LEAD_PHRASES)), F.lit(0))
        return F.array_join(dv.take_from(found, at, 4), " ")
    return t.descriptions.select("doc_id", dv.let(ss, lead).alias("lead"))


def _named(t):
    return t.descriptions.withColumn("name", dv.short_name("title", "dept"))


_NAMES = _steps().replace("{titles}", "{descriptions}")
_PARTS = f"""(select doc_id, case when len(p) < 3 then list_concat(p, {_uniq("early")}[1:3 - len(p)]) else p end as p from (
 select doc_id, p, list_filter(ss[1:greatest(k - 1, 0)], lambda x: not list_contains(p, x)) as early from (select doc_id, ss, k, ss[k:k + 3] as p from (
  select doc_id, ss, coalesce(nullif(list_position(list_transform(ss, lambda s: {_any('lower(s)', PROJECT_LEAD_PHRASES)}), true), 0), 1) as k from (select doc_id, {_WORK} as ss from {{descriptions}})))))"""
_DRAFT = f"""(select doc_id, case when len(p) = 0 then '' else array_to_string(p[1:list_max(list_filter(range(1, len(p) + 1), lambda n: n = 1 or length(array_to_string(p[1:n], ' ')) <= 900))], ' ') end as text from {_PARTS})"""
_CODED = f"""(select doc_id, name, dept, event_type, solicitation_number, case when length(text) < 60 and ph is not null then 'Provide ' || ph || ' in support of the ' || name || ' engagement.' else text end as text
 from {_DRAFT} join {{descriptions}} using (doc_id) join {_NAMES} using (doc_id) left join (select doc_id, string_agg(phrase, ', ' order by i) filter (r <= 3) as ph from (select *, row_number() over (partition by doc_id order by i) as r from {_PHRASE}) group by 1) using (doc_id))"""
_IS_ADMIN = f"""({_any('lower(text)', FILLER_PHRASES)} or len({_AW}) < 8 or len(list_filter({_AW}, lambda w: length(w) >= 3 and upper(w) = w)) > len({_AW}) * 0.2
 or len(regexp_extract_all(text, '\\b\\d+\\.\\s+[A-Z]')) >= 2 or regexp_matches(text, '\\b(NAME|EMAIL|ATTN|PHONE|FAX|ADDRESS|PART\\s+[IVX]+)\\s*:') or (length(text) < 120 and not {_any('lower(text)', PROJECT_SIGNAL_PHRASES)}))"""


@query("statement_of_work", f"""select doc_id, rtrim(substr(case when text = '' or {_IS_ADMIN} then concat_ws(' ', trim(coalesce(nullif(event_type, ''), 'Solicitation')) || ' for ' || name,
 '(solicitation ' || solicitation_number || ')', 'issued by ' || nullif(trim(string_split(dept, '.')[-1]), '')) || '.' else text end, 1, 900)) as statement_of_work from {_CODED}""")
def statement_of_work(t):
    return dv.statement_of_work(_named(t)).select("doc_id", "statement_of_work")


def _tier(name):
    return f"""(select doc_id, case when len(x) >= 2 then x[1:4] end as {name} from (select doc_id, list_filter(string_split(items, '|'), lambda i: length(i) > 10 and length(i) < 280) as x from ({CHECKS[name]})))"""


_TIERS = ("bulleted_items", "section_items", "obligation_sentences", "inline_list_items", "commodity_items", "label_items")


@query("deliverables", f"""select doc_id, array_to_string(coalesce({', '.join(_TIERS)}, ['Execute scope of work described in the ' || name || ' solicitation', 'Deliver milestones, status reporting, and acceptance documentation',
 'Provide final handoff and post-deployment support per RFP terms']), '|') as deliverables from {_NAMES} """ + " ".join(f"left join {_tier(n)} using (doc_id)" for n in _TIERS))
def deliverables(t):
    return dv.deliverables(_named(t)).select("doc_id", F.array_join("deliverables", "|").alias("deliverables"))


_CITY = "(values " + ", ".join(f"({_q(c)})" for c in CITIES) + ") as ct(city)"


@query("location", f"""with d as (select doc_id, coalesce(meeting_location, '') as a, coalesce(description, '') as b, coalesce(title, '') as c from {{descriptions}}),
 h as (select doc_id, min(struct_pack(tier := tier, city := city)) as best from (select doc_id, city, case when list_contains(list_transform(string_split(a, ','), lambda x: trim(x)), city) then 0
  when regexp_matches(a, '\\b' || city || '\\s*,\\s*(?:California|CA)\\b') then 1 when regexp_matches(a, '\\b' || city || '\\b') then 2
  when regexp_matches(b, '\\b' || city || '\\s*,\\s*(?:California|CA)\\b') then 3 when regexp_matches(b, '\\b' || city || '\\b') then 4
  when regexp_matches(c, '\\b' || city || '\\s*,\\s*(?:California|CA)\\b') then 5 when regexp_matches(c, '\\b' || city || '\\b') then 6 end as tier
  from d, {_CITY} where contains(a || ' ' || b || ' ' || c, city)) where tier is not null group by 1)
 select doc_id, coalesce(best.city, 'California') as location, case when best.city is not null then 'city' else 'state' end as location_level from d left join h using (doc_id)""")
def location(t):
    return dv.detect_location(t.descriptions.withColumn("name", F.lit(None).cast("string"))).select("doc_id", "location", "location_level")
