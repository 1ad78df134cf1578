"""Text cleaning queries over the whole documents and pages."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.catalog.tables import TABLES
from tenderspark.fixed import (ADDENDUM_WORDS, ADMIN_LEAD_PHRASES, DOCUMENT_LEAD_PHRASES, FILLER_PHRASES, PLACEHOLDER_MARKERS,
                               PROJECT_SIGNAL_PHRASES, PROSE_WORDS, RANK_BLOCKLIST, RANK_SPEC_HINTS, TRAILER_LINES)
from tenderspark.functions import text as tx
from tenderspark.operators import documents as docs

# Extracted attachment text with cover page, contents, anchors and form lines.
TABLES["attachment_text"] = """
select d.doc_id, 'FOR OFFICIAL USE ONLY' || chr(10) || 'Cover ..... 1' || chr(10) || ' Page 1 of 9 ' || chr(10)
 || case d.doc_id % 4 when 0 then 'See below. 1. Description:' || chr(10) || 'Old part.' || chr(10) || 'Scope of Work: ' || chr(10)
      when 1 then 'Preface text' || chr(10) || '1.2 Background' || chr(10) else '' end
 || case d.doc_id % 3 when 0 then 'This is a combined synopsis of the items that are in the list for the agency and the office. ' else '' end
 || replace(d.text, chr(10), chr(10) || chr(10)) || chr(10) || 'POINT OF CONTACT*' || chr(10) || 'Key Personnel' || chr(10) || '36C24126Q0465' || chr(10) || chr(10)
 || 'The vendor is to deliver the servers to the office and the staff shall install them in the racks of the state for the users.' as text
from {documents} d
"""
TABLES["attachments"] = """
select d.doc_id as notice_id, 0 as pos, case d.doc_id % 3 when 0 then 'SOW final.pdf' when 1 then 'Bidder list.pdf' else 'Plan.docx' end as label,
  case when d.doc_id % 4 = 0 then 'primary_spec' else 'attachment' end as type, 'http://f/' || cast(d.doc_id as string) as url, cast(null as string) as source_url,
  d.n_chars * 20 as size_bytes, substr(d.text, 1, 150) as text from {documents} d
union all select d.doc_id, 1, case d.doc_id % 4 when 0 then 'Addendum 2.pdf' when 1 then 'price.xlsx' when 2 then ' ' else 'Exhibit A' end,
  'attachment', 'http://g/' || cast(d.doc_id as string), 'http://s/', cast(null as bigint), d.text from {documents} d
union all select d.doc_id, 2, 'Requirements.docx', 'attachment', case when d.doc_id % 5 = 0 then '' else 'http://h/' end, cast(null as string), 260000, d.lang || ' ' || d.text from {documents} d
"""


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _any(expr, words):
    return "(" + " or ".join(f"contains({expr}, {_q(w)})" for w in words) + ")"


_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PARAS = "string_split_regex({0}, '\\n\\s*\\n')"


def _cut(expr, starts):
    return f"string_split(regexp_replace({expr}, '([.!?])\\s+([{starts}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


_SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_SENTENCES = "list_filter(list_transform(" + _cut(_SQ.format("text"), "A-Z0-9“\"''") + ", lambda x: trim(x)), lambda x: x <> '')"
_FILLER = f"(regexp_matches({{0}}, '^\\s*\\d{{{{2,}}}}[-/.]') or regexp_matches({{0}}, '^\\s*[A-Z]\\d+[A-Z0-9-]{{{{3,}}}}\\b') or {_any('lower({0})', FILLER_PHRASES)})"


@query("sentence_split", f"select doc_id, cast(len(s) as int) as n, array_to_string(s, '|') as sentences from (select doc_id, {_SENTENCES} as s from documents)")
def sentence_split(t):
    return t.documents.select("doc_id", tx.sentences("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


_DATE = "^\\s*\\d{1,2}/\\d{1,2}/\\d{2,4}\\s*$"
_HEAD = "(?i)^\\s*(this\\s+is\\s+(addendum|q\\s*&\\s*a|q\\s+and\\s+a)|addendum\\s+\\d+|q\\s*&\\s*a\\b|amendment\\s+\\d+|errata\\b)"


def _addenda(table):
    return f"""(select doc_id, trim(string_agg(block, chr(10) || chr(10) order by p), chr(10) || ' ') as text from (
 select doc_id, p, trim(string_agg(ln, chr(10) order by l) filter (not (dated and regexp_matches(ln, '{_DATE}'))
   and not (regexp_matches(trim(ln), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}\\s*[-–—:]') and {_any('lower(ln)', ADDENDUM_WORDS)})), chr(10) || ' ') as block
 from (select *, len(filled) >= 2 and regexp_matches(filled[1], '{_DATE}') as dated, coalesce(len(filled) >= 2 and regexp_matches(filled[1], '{_DATE}') and regexp_matches(trim(filled[2]), '{_HEAD}'), false) as dropped
   from (select doc_id, p, unnest(string_split(block, chr(10))) as ln, unnest(range(len(string_split(block, chr(10))))) as l, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') as filled
     from (select doc_id, unnest({_PARAS.format('text')}) as block, unnest(range(len({_PARAS.format('text')}))) as p from {table})))
 where not dropped group by doc_id, p) where block <> '' group by doc_id)"""


@query("addenda_removed", f"select doc_id, text from {_addenda('{portal_text}')}")
def addenda_removed(t):
    return t.portal_text.select("doc_id", tx.strip_addenda("text").alias("text"))


def _lead(table, phrases):
    return f"""(select doc_id, string_agg(para, chr(10) || chr(10) order by p) as text from (select doc_id, p, string_agg(trim(s, chr(10) || ' '), ' ' order by i) as para from (
  select *, max(case when not {_any('lower(s)', phrases)} then 1 else 0 end) over (partition by doc_id order by p, i rows between unbounded preceding and current row) as started
  from (select doc_id, p, unnest(ss) as s, unnest(range(len(ss))) as i from (select doc_id, p, {_cut('para', "A-Z“\"''")} as ss from (
    select doc_id, unnest({_PARAS.format('text')}) as para, unnest(range(len({_PARAS.format('text')}))) as p from {table}))) where trim(s, chr(10) || ' ') <> '')
  where started = 1 group by doc_id, p) group by doc_id)"""


@query("admin_lead_removed", f"select doc_id, text from {_lead('{attachment_text}', ADMIN_LEAD_PHRASES)}")
def admin_lead_removed(t):
    return t.attachment_text.select("doc_id", tx.strip_admin_lead("text").alias("text")).filter("text is not null")


def _capped(table, target):
    return f"""(select doc_id, case when any_value(length(full_text)) <= {target} then any_value(full_text) else string_agg(para, chr(10) || chr(10) order by p) filter (before < {target}) end as text from (
 select *, coalesce(sum(length(para) + 2) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0) as before from (
  select doc_id, text as full_text, unnest(list_transform({_PARAS.format('text')}, lambda x: {_S.format('x')})) as para, unnest(range(len({_PARAS.format('text')}))) as p from {table}) where para <> '' or full_text = '') group by doc_id)"""


@query("paragraph_cap", "select doc_id, text from " + _capped("(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)", 1400))
def paragraph_cap(t):
    return t.documents.select("doc_id", tx.cap_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))


_BUL = "^\\s*(?:[-*•¿]|\\d+[.)])\\s+"


def _limited(table):
    segs = f"""string_split('P' || array_to_string(list_transform(string_split(text, chr(10)), lambda ln: case when regexp_matches(ln, '{_BUL}')
   then chr(1) || 'B' || rtrim(trim(regexp_replace(ln, '{_BUL}', '')), ',;') || chr(1) || 'P' when trim(ln) = '' then chr(1) || 'P' else trim(ln) || ' ' end), ''), chr(1))"""
    units = f"""list_filter(flatten(list_transform({segs}, lambda s: case when s like 'B%' then [substr(s, 2)]
   else list_transform({_cut("trim(substr(s, 2))", "A-Z“\"''0-9")}, lambda x: trim(x)) end)), lambda x: x <> '')"""
    good = f"list_filter(u, lambda x: not {_FILLER.format('x')})[1:5]".replace("{{", "{").replace("}}", "}")
    return f"""(select doc_id, case when len(pick) = 0 then text else array_to_string(list_transform(pick, lambda x: case when right(x, 1) in ('.', '!', '?') then x else x || '.' end), ' ') end as text
 from (select doc_id, text, case when len(g) >= 4 then g else u[1:5] end as pick from (select doc_id, text, u, {good} as g from (
  select doc_id, text, list_filter({units}, lambda x: length(x) >= 25) as u from {table}))))"""


@query("sentence_limit", f"select doc_id, text from {_limited('{descriptions_text}')}".replace("{descriptions_text}", "(select doc_id, coalesce(description, '') as text from {descriptions})"))
def sentence_limit(t):
    return t.descriptions.select("doc_id", tx.limit_sentences(F.coalesce("description", F.lit(""))).alias("text"))


_LABEL = "(?i)^(event\\s*details|event\\s*id|format/?type|published\\s*date|dept|event\\s*version|event\\s*end\\s*date)\\s*:?$"


def _body(table):
    trail = " or ".join(f"lower(ln) = {_q(w)}" for w in TRAILER_LINES)
    return f"""(select doc_id, trim(regexp_replace(string_agg(ln, chr(10) order by l), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) as text from (
 select *, min(case when l > coalesce(st, -1) and ({trail} or ln ilike 'pre bid conference%' or ln ilike 'pre-bid conference%') then l end) over (partition by doc_id) as en from (
  select *, min(case when regexp_matches(ln, '(?i)^(?:\\d+\\.\\s+)?description\\s*:?$') then l end) over (partition by doc_id) as st from (
   select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {_S.format('x')})) as ln, unnest(range(len(string_split(text, chr(10))))) as l from {table})))
 where l > coalesce(st, -1) and (en is null or l < en) and not regexp_matches(ln, '{_LABEL}') and not regexp_matches(ln, '(?i)^event\\s*:\\s*\\S+$') group by doc_id)"""


@query("description_body", f"select doc_id, text from {_body('{portal_text}')}")
def description_body(t):
    return t.portal_text.select("doc_id", tx.description_body("text").alias("text"))


@query("clean_description", f"select doc_id, text from {_limited(_capped(_lead(_addenda(_body('{portal_text}')), ADMIN_LEAD_PHRASES), 1400))}")
def clean_description(t):
    return t.portal_text.select("doc_id", tx.clean_description("text").alias("text"))


_NOISE = "text"
for _p in ("Distribution Statement A\\.\\s*Approved for public release[^\\n]*", "THIS PAGE LEFT INTENTIONALLY BLANK", "^\\s*Page \\d+ of \\d+\\s*$", "FOR OFFICIAL USE ONLY", "CHANGE\\s+HISTORY"):
    _NOISE = f"regexp_replace({_NOISE}, '(?im){_p}', '', 'g')"
_ANCHOR = "(?i)(?:^|[.!?]\\s|\\n)\\s*(?:\\d+\\.\\s+)?(?:statement\\s+of\\s+work|scope\\s+of\\s+work|description\\s+of\\s+services|description|sow)\\s*:\\s*(?:\\n|$)"
_SHEAD = "(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\s+)?(?:scope|introduction|overview|background|purpose|statement\\s+of\\s+work|sow|objectives?|executive\\s+summary|general\\s+information|summary|description\\s+of\\s+services)\\s*$"
_DOCTEXT = f"""(select doc_id, {_S.format("regexp_replace(regexp_replace(regexp_replace(b, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as text from (
 select doc_id, case when contains(m, chr(1)) then string_split(m, chr(1))[-1] when h is not null then array_to_string(string_split(m, chr(10))[h + 1:], chr(10)) else m end as b from (
  select *, list_filter(list_transform(string_split(m, chr(10))[1:120], lambda x, i: case when regexp_matches(x, '{_SHEAD}') then i end), lambda i: i is not null)[1] as h from (
   select doc_id, regexp_replace(array_to_string(list_filter(string_split({_NOISE}, chr(10)), lambda x: not regexp_matches(x, '\\.{{4,}}')), chr(10)), '{_ANCHOR}', chr(1), 'g') as m from {{attachment_text}}))))"""


@query("document_text", f"select doc_id, text from {_DOCTEXT}")
def document_text(t):
    return t.attachment_text.select("doc_id", tx.document_text("text").alias("text"))


def _formline(x):
    return f"(regexp_matches({x}, '{tx.FORM_LINE.replace(chr(39), chr(39) * 2)}') or regexp_matches({x}, '{tx.TITLE_LINE}') or regexp_matches({x}, '{tx.CAPS_LINE}') or regexp_matches({x}, '{tx.CODE_LINE}'))"


_PROSE_SET = "[" + ", ".join(_q(w) for w in PROSE_WORDS) + "]"


def _narrative(x):
    words = f"regexp_extract_all(lower({x}), '[a-z]+')"
    return (f"(length({x}) >= 60 and not {_formline(x)} and (len(regexp_extract_all({x}, '\\p{{L}}')) = 0 or len(regexp_extract_all({x}, '\\p{{Lu}}')) <= len(regexp_extract_all({x}, '\\p{{L}}')) * 0.55)"
            f" and len({words}) >= 12 and len(list_filter({words}, lambda w: list_contains({_PROSE_SET}, w))) >= 3)")


@query("paragraph_quality", f"select doc_id, p, narrative from (select doc_id, p, {_narrative('para')} as narrative from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as para, unnest(range(len(string_split(text, chr(10))))) as p from {{attachment_text}}))")
def paragraph_quality(t):
    lines = t.attachment_text.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")) \
        .select("doc_id", F.col("p").cast("bigint").alias("p"), tx.strip("line").alias("line"))
    return lines.select("doc_id", "p", tx.is_narrative(F.col("line")).alias("narrative"))


_PRUNED = f"(select doc_id, text as fallback, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x = '' or not {_formline('x')}), chr(10)) as text from {_DOCTEXT})"
_KEPT = f"""(select doc_id, string_agg(para, chr(10) || chr(10) order by p) as text from (select *, coalesce(sum(length(para) + 2) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0) as before
 from (select doc_id, unnest(list_transform({_PARAS.format('text')}, lambda x: {_S.format('x')})) as para, unnest(range(len({_PARAS.format('text')}))) as p from {_PRUNED}) where {_narrative('para')}) where before < 1800 group by doc_id)"""


@query("clean_document_text", f"select doc_id, coalesce(l.text, d.text) as text from {_DOCTEXT} d left join {_lead(_KEPT, DOCUMENT_LEAD_PHRASES)} l using (doc_id)")
def clean_document_text(t):
    return t.attachment_text.select("doc_id", tx.clean_document_text("text").alias("text"))


_ADMIN_TEXT = "(select doc_id, case doc_id % 5 when 0 then substr(text, 1, 400) when 1 then 'The system will host the records of the agency in the new data room.' when 2 then 'NAME: ' || substr(text, 1, 300) when 3 then '1. Alpha beta 2. Gamma delta ' || substr(text, 1, 300) else upper(substr(text, 1, 200)) || substr(text, 1, 200) end as text from documents)"
_AW = "regexp_extract_all(text, '[A-Za-z][A-Za-z/-]+')"


@query("pure_admin_text", f"""select doc_id, {_any('lower(text)', FILLER_PHRASES)} or len({_AW}) < 8 or len(list_filter({_AW}, lambda w: length(w) >= 3 and upper(w) = w)) > len({_AW}) * 0.2
 or len(regexp_extract_all(text, '\\b\\d+\\.\\s+[A-Z]')) >= 2 or regexp_matches(text, '\\b(NAME|EMAIL|ATTN|PHONE|FAX|ADDRESS|PART\\s+[IVX]+)\\s*:')
 or (length(text) < 120 and not {_any('lower(text)', PROJECT_SIGNAL_PHRASES)}) as pure_admin from {_ADMIN_TEXT}""")
def pure_admin_text(t):
    texts = t.spark.sql("select * from " + _ADMIN_TEXT.replace("from documents", "from {documents}"), documents=t.documents)
    return texts.select("doc_id", tx.is_pure_admin("text").alias("pure_admin"))


_BLOCKS = "p|br|div|li|tr|ul|ol|h1|h2|h3|h4|h5|h6|table"
_HTML = f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:{_BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (" ", " ")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query("page_text", "select page_id, " + _S.format(f"regexp_replace(regexp_replace({_HTML}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')") + " as text from pages")
def page_text(t):
    return t.pages.select("page_id", tx.html_to_text("html").alias("text"))


@query("page_text_parsed")
def page_text_parsed(t):
    return t.pages.select("page_id", tx.html_to_text_parsed("html").alias("text"))


@query("page_flat_text", """select page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100000) as text
 from pages where length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) >= 80""")
def page_flat_text(t):
    return t.pages.select("page_id", tx.html_to_flat_text("html").alias("text")).filter(tx.readable(F.col("text")))


_TEMPLATE = "(select page_id, case page_id % 4 when 0 then '[Event' || chr(10) || ' Title] Loading... ' || url when 1 then 'Call [Phone] of ' || url when 2 then '  ' else html end as text from pages)"


@query("placeholder_pages", "select page_id, trim(text) = '' or " + _any("lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))", PLACEHOLDER_MARKERS) + " as placeholder from " + _TEMPLATE)
def placeholder_pages(t):
    texts = t.spark.sql("select * from " + _TEMPLATE.replace("from pages", "from {pages}"), pages=t.pages)
    return texts.select("page_id", tx.is_placeholder("text").alias("placeholder"))


def _scored(addenda):
    block = [w for w in RANK_BLOCKLIST if not (addenda and w in ("addendum", "amendment"))]
    return f"""(select *, case when type = 'primary_spec' then -10 else 0 end - case when {_any('low', RANK_SPEC_HINTS)} then 5 else 0 end - least(floor(coalesce(size_bytes, 0) / 50000), 4) + case when low like '%.docx' then 1 else 0 end as score
 from (select *, lower(trim(label)) as low from {{attachments}}) where coalesce(nullif(source_url, ''), url) <> '' and not regexp_matches(low, '\\.(xlsx|xls|zip|pptx|csv|doc)$') and not {_any('low', block)})"""


@query("document_ranking", f"select notice_id, pos, cast(score as bigint) as score, cast(row_number() over (partition by notice_id order by score, pos) as int) as rank from {_scored(False)}")
def document_ranking(t):
    return docs.rank_documents(t.attachments).select("notice_id", "pos", "score", "rank")


_BEST = f"(select notice_id, coalesce(arg_min(text, (score, pos)) filter (length(text) >= 200), arg_max(text, (score, pos))) as document_text from {_scored(False)} where text <> '' group by 1)"


@query("description_backfill", f"select notice_id, case when trim(coalesce(description, '')) <> '' then description else coalesce(document_text, description) end as description from (select notice_id, case when notice_id % 2 = 0 then ' ' else description end as description from {{notices}}) left join {_BEST} using (notice_id)")
def description_backfill(t):
    notices = t.notices.select("notice_id", F.when(F.col("notice_id") % 2 == 0, " ").otherwise(F.col("description")).alias("description"))
    return docs.backfill_description(notices, t.attachments).select("notice_id", "description")


_TOP5 = f"(select notice_id, row_number() over (partition by notice_id order by score, pos) as r, coalesce(nullif(trim(label), ''), 'Attached document') || chr(10) || " + _S.format("substr(text, 1, 80000)") + f" as block from {_scored(True)} where length(text) >= 200 qualify r <= 5)"
_SINGLE = "(select doc_id as notice_id, case when doc_id % 2 = 0 then substr(text, 1, 300) else 'Single ' || text end as single_text from documents)"


@query("document_concat", f"""select notice_id, array_to_string(case when trim(coalesce(s.single_text, '')) <> '' and len(list_filter(coalesce(b, []), lambda x: contains(x, substr(trim(s.single_text), 1, 100)))) = 0 then list_append(coalesce(b, []), {_S.format('s.single_text')}) else b end, chr(10) || chr(10)) as document_text
 from (select notice_id, list(block order by r) as b from {_TOP5} group by 1) full join {_SINGLE} s using (notice_id)""")
def document_concat(t):
    single = t.spark.sql("select * from " + _SINGLE.replace("from documents", "from {documents}"), documents=t.documents)
    return docs.concat_documents(t.attachments, single)


@query("admin_description_override", f"""select doc_id, case when adm then nullif(trim(sow), '') else text end as description from (select doc_id, text, case when doc_id % 2 = 0 then ' work ' else ' ' end as sow,
 {_any('lower(text)', FILLER_PHRASES)} or len({_AW}) < 8 or len(list_filter({_AW}, lambda w: length(w) >= 3 and upper(w) = w)) > len({_AW}) * 0.2
 or len(regexp_extract_all(text, '\\b\\d+\\.\\s+[A-Z]')) >= 2 or regexp_matches(text, '\\b(NAME|EMAIL|ATTN|PHONE|FAX|ADDRESS|PART\\s+[IVX]+)\\s*:')
 or (length(text) < 120 and not {_any('lower(text)', PROJECT_SIGNAL_PHRASES)}) as adm from {_ADMIN_TEXT})""")
def admin_description_override(t):
    texts = t.spark.sql("select * from " + _ADMIN_TEXT.replace("from documents", "from {documents}"), documents=t.documents)
    df = texts.select("doc_id", F.col("text").alias("description"), F.when(F.col("doc_id") % 2 == 0, " work ").otherwise(" ").alias("statement_of_work"))
    return tx.override_admin_description(df).select("doc_id", "description")
