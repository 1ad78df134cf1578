"""Chunking and retrieval queries over the whole tables."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.catalog.tables import TABLES
from tenderspark.operators import feed
from tenderspark.operators import retrieval as rt
from tenderspark.operators import scoring as sc
from tenderspark.operators.ranking import top_per_key
from tenderspark.session import stage

_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_RULE = "(chr(10) || chr(10) || '---' || chr(10) || chr(10))"

TABLES["chunk_texts"] = """select e.vec_id as chunk_id, e.label as notice_id, coalesce(d.text, 'chunk ' || cast(e.vec_id as string)) as chunk_text from {embeddings} e left join {documents} d on e.vec_id = d.doc_id"""
TABLES["project_vectors"] = """select p.project_id, p.contractor_id, p.project_name, p.description, case when p.project_id % 3 = 0 then cast(null as string) else 'v' end as embedding from {past_projects} p"""
# Vectors of contractors' goals, of notices and of past work, and eight chunks for two thirds of the saved notices.
_N_VECTORS = "(select count(*) from {embeddings})"
TABLES["contractor_vectors"] = f"""select c.contractor_id, e.embedding from (select c_custkey as contractor_id, c_custkey % {_N_VECTORS} as v from {{customer}}) c join {{embeddings}} e on e.vec_id = c.v where c.contractor_id % 10 <> 4"""
TABLES["saved_notice_vectors"] = f"""select n.notice_id, e.embedding from (select notice_id, (notice_id * 5 + 1) % {_N_VECTORS} as v from (select distinct notice_id from {{saved}}) s) n join {{embeddings}} e on e.vec_id = n.v"""
TABLES["past_vectors"] = f"""select p.project_id, p.contractor_id, p.project_name, p.description, e.embedding from (select *, (project_id * 3 + 2) % {_N_VECTORS} as v from {{past_projects}}) p join {{embeddings}} e on e.vec_id = p.v"""
TABLES["saved_notice_chunks"] = f"""select n.chunk_id, n.notice_id, 'excerpt ' || cast(n.chunk_id as string) as chunk_text, e.embedding from (select notice_id * 8 + j as chunk_id, notice_id, (notice_id * 13 + j * 37) % {_N_VECTORS} as v
 from (select distinct notice_id from {{saved}}) s cross join (values (0), (1), (2), (3), (4), (5), (6), (7)) t(j) where notice_id % 3 <> 0) n join {{embeddings}} e on e.vec_id = n.v"""
# One notice per document, with the sections that are cut into chunks.
TABLES["bodies"] = """select d.doc_id as notice_id, case when d.doc_id % 5 = 0 then ' ' else 'Doc ' || cast(d.doc_id as string) end as title, case when d.doc_id % 7 = 0 then cast(null as string) else d.text end as description,
 case when d.doc_id % 2 = 0 then ' Work. ' end as statement_of_work, case when d.doc_id % 3 = 0 then ARR('a', 'b') else NULLARR end as deliverables, case when d.doc_id % 4 = 0 then d.lang || chr(10) || d.text end as document_text, d.source, d.lang from {documents} d"""

_BODY = """(select notice_id, coalesce(nullif(concat_ws(chr(10) || chr(10), case when trim(title) <> '' then 'Title:' || chr(10) || trim(title) end, case when trim(description) <> '' then 'Description:' || chr(10) || """ + _S.format("description") + """ end,
 case when trim(statement_of_work) <> '' then 'Statement of Work:' || chr(10) || trim(statement_of_work) end, case when len(deliverables) > 0 then 'Deliverables:' || chr(10) || array_to_string(deliverables, chr(10)) end,
 case when document_text <> '' then 'Extracted Attachment Text:' || chr(10) || document_text end), ''), '(No description provided for this RFP.)') as body from {bodies})"""


@query("chunk_bodies", "select notice_id, " + _S.format("body") + " as body from " + _BODY)
def chunk_bodies(t):
    return rt.chunk_body(t.bodies).select("notice_id", "body")


@query("chunks", f"""with recursive b as (select notice_id, {_S.format('body')} as x from {_BODY}),
 w as (select notice_id, x, 0 as s, 0 as k from b where x <> '' union all
  select notice_id, x, greatest(e - 180, s + 1) as s, k + 1 as k from (select notice_id, x, s, k, case when s + 1200 >= length(x) then length(x) when para > 480 then s + para + 2 when nl > 480 then s + nl + 1 else s + 1200 end as e
   from (select *, case when strpos(reverse(substr(x, s + 1, 1200)), chr(10) || chr(10)) = 0 then -1 else 1200 - strpos(reverse(substr(x, s + 1, 1200)), chr(10) || chr(10)) - 1 end as para,
     case when strpos(reverse(substr(x, s + 1, 1200)), chr(10)) = 0 then -1 else 1200 - strpos(reverse(substr(x, s + 1, 1200)), chr(10)) end as nl from w)) where e < length(x)),
 z as (select notice_id, k, {_S.format("substr(x, s + 1, (case when s + 1200 >= length(x) then length(x) when para > 480 then s + para + 2 when nl > 480 then s + nl + 1 else s + 1200 end) - s)")} as chunk_text
   from (select *, case when strpos(reverse(substr(x, s + 1, 1200)), chr(10) || chr(10)) = 0 then -1 else 1200 - strpos(reverse(substr(x, s + 1, 1200)), chr(10) || chr(10)) - 1 end as para,
     case when strpos(reverse(substr(x, s + 1, 1200)), chr(10)) = 0 then -1 else 1200 - strpos(reverse(substr(x, s + 1, 1200)), chr(10)) end as nl from w))
 select notice_id, cast(row_number() over (partition by notice_id order by k) - 1 as int) as chunk_index, chunk_text from z where chunk_text <> ''""")
def chunks(t):
    return rt.chunk(rt.chunk_body(t.bodies))


@query("fixed_chunks", """select notice_id, cast(i as int) as chunk_index, substr(body, cast(i * 1020 + 1 as int), 1200) as chunk_text from (select notice_id, body, unnest(range(0, cast(greatest(ceil((length(body) - 1200) / 1020), 0) as bigint) + 1)) as i
 from (select doc_id as notice_id, text as body from documents))""")
def fixed_chunks(t):
    return rt.fixed_chunks(t.documents.select(F.col("doc_id").alias("notice_id"), F.col("text").alias("body")))


@query("notices_without_chunks", "select notice_id, title from {notices} where notice_id not in (select label from embeddings)")
def notices_without_chunks(t):
    return rt.missing_chunks(t.notices, t.chunks).select("notice_id", "title")


@query("projects_without_vector", "select project_id, concat_ws(chr(10), nullif(trim(project_name), ''), nullif(trim(description), '')) as text from {past_projects} where project_id % 3 = 0")
def projects_without_vector(t):
    return rt.missing_project_vectors(t.project_vectors)


@query("embedding_dims", "select len(embedding) as dim, count(*) as n from embeddings group by 1")
def embedding_dims(t):
    return rt.embedding_dims(t.embeddings)


@query("incomplete_embeddings", """select notice_id, count(*) as n_pieces, count(*) filter (where chunk_id % 5 <> 0) as n_vectors from {saved_notice_chunks} group by 1 having count(*) <> count(*) filter (where chunk_id % 5 <> 0)""")
def incomplete_embeddings(t):
    """Of the chunks of saved notices every fifth has no vector yet."""
    got = t.saved_notice_chunks.withColumn("embedding", F.when(F.col("chunk_id") % 5 != 0, F.col("embedding")))
    return rt.incomplete_embeddings(t.saved_notice_chunks, got)


def _vectors(t):
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "label", "embedding")
    items = t.embeddings.select(F.col("vec_id").alias("item_id"), "label", "embedding")
    return queries, items


def _top(k, threshold, extra=""):
    return f"""(select q.vec_id as query_id, i.vec_id as item_id, list_cosine_similarity(q.embedding::double[], i.embedding::double[]) as sim
 from embeddings q join embeddings i on list_cosine_similarity(q.embedding::double[], i.embedding::double[]) > {threshold} {extra}
 qualify row_number() over (partition by q.vec_id order by sim desc, i.vec_id) <= {k})"""


@query("chunk_top_k", "select query_id, item_id, round(sim, 6) as sim, cast(row_number() over (partition by query_id order by sim desc, item_id) as int) as rank from " + _top(10, 0.2))
def chunk_top_k(t):
    queries, items = _vectors(t)
    return rt.topk_join(queries, items, 10, 0.2).withColumn("sim", F.round("sim", 6))


@query("project_top_k", "select query_id, item_id, round(sim, 6) as sim, cast(row_number() over (partition by query_id order by sim desc, item_id) as int) as rank from " + _top(5, 0.2, "and q.label = i.label"))
def project_top_k(t):
    queries, items = _vectors(t)
    return rt.topk_join(queries, items, 5, 0.2, partition="label").withColumn("sim", F.round("sim", 6))


@query("chunk_top_k_in_open_notices", "select query_id, item_id, round(sim, 6) as sim from " + _top(6, 0.2, "and i.label in (select notice_id from {notices} where status = 'active' and is_relevant)"))
def chunk_top_k_in_open_notices(t):
    queries, items = _vectors(t)
    open_ids = feed.base_feed(t.notices).select(F.col("notice_id").alias("label"))
    return rt.topk_join(queries, items.join(open_ids, "label", "left_semi"), 6, 0.2).select("query_id", "item_id", F.round("sim", 6).alias("sim"))


@query("chunk_top_k_approximate")
def chunk_top_k_approximate(t):
    queries, items = _vectors(t)
    return rt.topk_cells(queries, items, 10, 0.2).withColumn("sim", F.round("sim", 6))


@query("approximate_recall", "select count(*) as n_exact, true as enough from " + _top(10, 0.2))
def approximate_recall(t):
    """Of the exact results of every vector, whether the approximate search gives 0.9 or more, and none besides them with another similarity."""
    queries, items = _vectors(t)
    exact = rt.topk_join(queries, items, 10, 0.2).select("query_id", "item_id", F.lit(1).alias("exact"))
    found = rt.topk_cells(queries, items, 10, 0.2).select("query_id", "item_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "item_id"], "left").agg(F.count("exact").alias("n_exact"), (F.coalesce(F.count("found") / F.count("exact"), F.lit(1.0)) >= 0.9).alias("enough"))


_PAIRS = "(select vec_id as query_id, case when vec_id % 9 = 0 then vec_id % 40 else label end as notice_id from embeddings)"
_HITS = "(select query_id, item_id, sim, chunk_text, row_number() over (partition by query_id order by sim desc, item_id) as rank from " + _top(6, 0.2) + " h join {chunk_texts} c on c.chunk_id = h.item_id)"
_EVIDENCE = f"""(select query_id, notice_id, rank, chunk_text, sim from {_PAIRS} join {_HITS} using (query_id)
 union all select query_id, notice_id, 1, substr(coalesce(description, title), 1, 4000), 0 from {_PAIRS} join {{notices}} using (notice_id) where query_id not in (select query_id from {_HITS}))"""


def _evidence(t):
    queries, items = _vectors(t)
    hits = stage(rt.topk_join(queries, items, 6, 0.2), "evidence-hits")
    texts = t.chunk_texts.select(F.col("chunk_id").alias("item_id"), "chunk_text")
    pairs = queries.select("query_id", F.when(F.col("query_id") % 9 == 0, F.col("query_id") % 40).otherwise(F.col("label")).alias("notice_id"))
    return rt.evidence_with_fallback(pairs, hits.join(texts, "item_id"), t.notices.select("notice_id", "title", "description"))


@query("evidence_with_fallback", f"select query_id, notice_id, cast(rank as int) as rank, chunk_text, round(sim, 6) as sim from {_EVIDENCE}")
def evidence_with_fallback(t):
    return _evidence(t).withColumn("sim", F.round("sim", 6))


@query("project_fallback", """with h as (select contractor_id, project_id, cast(row_number() over (partition by contractor_id order by project_id desc) as int) as rank, 0.5::double as sim from {past_projects} where project_name = 'Experience profile' qualify rank <= 2)
 select * from h union all select contractor_id, project_id, cast(row_number() over (partition by contractor_id order by project_id) as int), 0 from {past_projects} where contractor_id not in (select contractor_id from h) qualify row_number() over (partition by contractor_id order by project_id) <= 5""")
def project_fallback(t):
    hits = top_per_key(t.past_projects.filter("project_name = 'Experience profile'"), ["contractor_id"], [F.col("project_id").desc()], 2, rank="rank").withColumn("sim", F.lit(0.5))
    return rt.project_fallback(t.contractors, hits, t.past_projects)


_EXC = "substr({0}, 1, 320) || case when length({0}) > 320 then '…' else '' end"
_PROJ = "(select query_id, rank, project_name, description, 0.25 + rank / 8 as sim from (select contractor_id as query_id, cast(row_number() over (partition by contractor_id order by project_id) as int) as rank, project_name, description from {past_projects} qualify rank <= 3) where query_id in (select vec_id from embeddings))"
_HEAD = "'### ' || ref || head || chr(10) || '(similarity ' || printf('%.3f', sim) || ')' || chr(10) || body"


@query("citations", f"""select query_id, string_agg({_HEAD}, {_RULE} order by kind, rank) as block, string_agg(ref, ' ' order by kind, rank) as refs, string_agg({_EXC.format('body')}, '|' order by kind, rank) as excerpts from (
 select query_id, 0 as kind, rank, 'R' || rank as ref, chunk_text as body, '' as head, sim from {_EVIDENCE}
 union all select query_id, 1, rank, 'P' || rank, concat_ws(chr(10), project_name, description), ': ' || project_name, sim from {_PROJ}) group by 1""")
def citations(t):
    projects = top_per_key(t.past_projects.withColumnRenamed("contractor_id", "query_id"), ["query_id"], [F.col("project_id")], 3, rank="rank") \
        .withColumn("sim", F.lit(0.25) + F.col("rank") / 8).join(t.embeddings.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    return rt.citations(_evidence(t), projects.select("query_id", "rank", "project_name", "description", "sim")).withColumn("excerpts", F.array_join("excerpts", "|"))




def _section(name, expr):
    return f"case when trim(coalesce({expr}, '')) <> '' then '## {name}' || chr(10) || substr({_S.format(expr)}, 1, 80000) end"


_FIX = "(select notice_id, i as chunk_index, substr(body, cast(i * 1020 + 1 as int), 1200) as chunk_text from (select notice_id, body, unnest(range(0, cast(greatest(ceil((length(body) - 1200) / 1020), 0) as bigint) + 1)) as i from (select doc_id as notice_id, text as body from documents)))"


@query("context_documents", f"""select notice_id, substr(concat_ws(chr(10) || chr(10), {_section('Canonical RFP Fields', "concat_ws(chr(10), 'Source: ' || nullif(trim(source), ''), 'Title: ' || nullif(trim(title), ''), 'Language: ' || nullif(trim(lang), ''))")},
 {_section('Description', 'description')}, {_section('Statement of Work', 'statement_of_work')}, {_section('Deliverables', "array_to_string(deliverables, chr(10))")}, {_section('Attached Documents', "'Document 1: label: ' || source")},
 {_section('Source Metadata', "chr(123) || '\"lang\":\"' || lang || '\"' || chr(125)")}, {_section('Extracted Attachment Text', 'document_text')},
 {_section('Indexed RFP Chunks', 'cs')}), 1, 200000) as context from {{bodies}} left join (select notice_id, string_agg('### Chunk ' || chunk_index || chr(10) || chunk_text, {_RULE} order by chunk_index) as cs from {_FIX} group by 1) using (notice_id)""")
def context_documents(t):
    bodies = t.bodies.withColumn("metadata_json", rt.light_metadata(F.create_map(F.lit("lang"), F.col("lang"), F.lit("documents"), F.col("description")))) \
        .withColumn("document_lines", F.array(F.concat(F.lit("Document 1: label: "), "source"), F.concat(F.lit("Document 1: label: "), "source"), F.lit(" ")))
    pieces = rt.fixed_chunks(t.documents.select(F.col("doc_id").alias("notice_id"), F.col("text").alias("body")))
    return rt.context_document(bodies, pieces, [("Source", "source"), ("Title", "title"), ("Language", "lang")])


@query("query_texts", "select notice_id, substr(" + _S.format("concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(description, ''))") + ", 1, 12000) as text from {notices}")
def query_texts(t):
    return t.notices.select("notice_id", rt.query_text([F.col("title"), F.col("description")]).alias("text"))


@query("summary_requests", f"""select notice_id, concat_ws(chr(10), 'RECORD METADATA', 'Source: ' || source, 'Title: ' || trim(title), 'Issuing department / agency: ' || coalesce(trim(department), ''), 'Notice / event type: ' || event_type, 'Solicitation number: ' || external_id,
 'Place of performance: ' || concat_ws(', ', nullif(trim(location), ''), state), 'NAICS codes: ' || array_to_string(naics_codes, ', '), 'UNSPSC category descriptions:' || chr(10) || '- ' || array_to_string(tags, chr(10) || '- '),
 'Attached document labels:' || chr(10) || '- ' || array_to_string(deliverables, chr(10) || '- '), chr(10) || '---' || chr(10) || 'CLEANED DESCRIPTION (from website scrape):', coalesce(nullif(substr(description, 1, 8000), ''), '(none)'),
 chr(10) || '---' || chr(10) || 'ATTACHED DOCUMENT TEXT (extracted from PDFs / DOCX):', coalesce(nullif(substr(statement_of_work, 1, 30000), ''), '(none)')) as request from {{notices}}""")
def summary_requests(t):
    return rt.summary_requests(t.notices.select(
        "notice_id", "source", "title", F.col("department").alias("dept"), "event_type", F.col("external_id").alias("solicitation_number"), F.array("location", "state").alias("place_names"),
        "naics_codes", F.col("tags").alias("code_descriptions"), F.col("deliverables").alias("labels"), "description", F.col("statement_of_work").alias("document_text")))


_PAIR = "(select s.contractor_id, n.notice_id, n.title, n.description from {saved} s join {notices} n using (notice_id))"
_PAST3 = "(select contractor_id, cast(row_number() over (partition by contractor_id order by project_id) as int) as rank, project_name, description, tags from {past_projects} qualify rank <= 3)"


def _pairs(t):
    return t.saved.select("contractor_id", "notice_id").join(t.notices.select("notice_id", "title", "description"), "notice_id")


def _past(t):
    return top_per_key(t.past_projects, ["contractor_id"], [F.col("project_id")], 3, rank="rank").select("contractor_id", "rank", "project_name", "description", "tags")


_SIM = "list_cosine_similarity({0}.embedding::double[], {1}.embedding::double[])"
# Six chunks of the pair's own notice, else its description or title.
_EXCERPTS = f"""(with h as (select p.contractor_id, p.notice_id, i.chunk_text, {_SIM.format('q', 'i')} as sim, i.chunk_id from {_PAIR} p join {{contractor_vectors}} q using (contractor_id) join {{saved_notice_chunks}} i using (notice_id)
  where sim > 0.2 qualify row_number() over (partition by p.contractor_id, p.notice_id order by sim desc, chunk_id) <= 6)
 select contractor_id, notice_id, string_agg('### RFP excerpt ' || rank || chr(10) || chunk_text, chr(10) || chr(10) order by rank) as e from (
  select contractor_id, notice_id, chunk_text, row_number() over (partition by contractor_id, notice_id order by sim desc, chunk_id) as rank from h
  union all select contractor_id, notice_id, substr(coalesce(description, title), 1, 4000), 1 from {_PAIR} where (contractor_id, notice_id) not in (select (contractor_id, notice_id) from h)) group by 1, 2)"""
_SHOWN = f"""(with h as (select p.contractor_id, p.notice_id, i.project_id, i.project_name, i.description, {_SIM.format('q', 'i')} as sim from {_PAIR} p join {{saved_notice_vectors}} q using (notice_id) join {{past_vectors}} i using (contractor_id)
  where sim > 0.2 qualify row_number() over (partition by p.contractor_id, p.notice_id order by sim desc, i.project_id) <= 5)
 select contractor_id, notice_id, string_agg('### Past project ' || rank || ': ' || project_name || chr(10) || coalesce(description, '(no description)'), chr(10) || chr(10) order by rank) as p, string_agg(project_name, '|' order by rank) as names from (
  select contractor_id, notice_id, project_name, description, row_number() over (partition by contractor_id, notice_id order by sim desc, project_id) as rank from h
  union all select contractor_id, notice_id, f.project_name, f.description, f.rank from {_PAIR} join (select *, row_number() over (partition by contractor_id order by project_id) as rank from {{past_projects}} qualify rank <= 5) f using (contractor_id)
   where (contractor_id, notice_id) not in (select (contractor_id, notice_id) from h)) group by 1, 2)"""


def _excerpts(t):
    """Chunks of each saved notice nearest to the contractor's vector."""
    return rt.pair_excerpts(_pairs(t).join(t.contractor_vectors, "contractor_id", "left"), t.saved_notice_chunks)


def _shown(t):
    """Past projects of each contractor nearest to the saved notice's vector."""
    return rt.pair_projects(_pairs(t).join(t.saved_notice_vectors, "notice_id", "left"), t.past_vectors)


@query("pair_excerpts", f"select contractor_id, notice_id, e as excerpts from {_EXCERPTS}")
def pair_excerpts(t):
    text = F.concat(F.lit("### RFP excerpt "), F.col("rank"), F.lit("\n"), F.col("chunk_text"))
    return rt._numbered(_excerpts(t), ["contractor_id", "notice_id"], text, "excerpts")


@query("experience_requests", f"""select contractor_id, notice_id, 'RFP: ' || title || chr(10) || chr(10) || '## Most relevant RFP excerpts' || chr(10) || e || chr(10) || chr(10) || '## Contractor past performance' || chr(10)
 || coalesce(p, '(Contractor has no past projects on file.)') as request from {_PAIR} join {_EXCERPTS} using (contractor_id, notice_id) left join {_SHOWN} using (contractor_id, notice_id)""")
def experience_requests(t):
    return rt.experience_requests(_pairs(t), _excerpts(t), _shown(t))


@query("experience_with_retrieved_work", f"""select contractor_id, notice_id, case when names is null then 0 else coalesce(j.score, 0) end as score, case when j.score is null then '' else coalesce(names, '') end as matched from {_PAIR} left join {_SHOWN} using (contractor_id, notice_id)
 left join (select contractor_id, notice_id, score from {{judgements}} where factor = 'experience') j using (contractor_id, notice_id)""")
def experience_with_retrieved_work(t):
    """The judged factor names the work that was retrieved for the judge."""
    judged = sc.experience(_pairs(t), t.past_projects, t.judgements, _shown(t))
    return judged.select("contractor_id", "notice_id", "score", F.array_join("matched_past_projects", "|").alias("matched"))


@query("goals_requests", f"""select contractor_id, notice_id, 'RFP: ' || title || chr(10) || chr(10) || '## Most relevant RFP excerpts' || chr(10) || e || chr(10) || chr(10) || '## Contractor''s stated goals' || chr(10)
 || coalesce(nullif(trim(goals), ''), '(empty)') as request from {_PAIR} join {_EXCERPTS} using (contractor_id, notice_id) join (select contractor_id, goals from {{contractors}}) using (contractor_id)""")
def goals_requests(t):
    pairs = _pairs(t).join(t.contractors.select("contractor_id", "goals"), "contractor_id")
    return rt.goals_requests(pairs, _excerpts(t))


@query("reasoning_requests", """select contractor_id, notice_id, 'Contractor: ' || company_name || chr(10) || 'RFP: ' || n.title || chr(10) || 'Overall score: ' || cast(floor(score) as int) || '/100' || chr(10) || chr(10) || 'Factor breakdown:' || chr(10) || '- timing: ' || cast(floor(score) as int) || chr(10) || '- goals: 0' as request
 from (select contractor_id, notice_id, arg_max(score, score_id) as score from {scores} group by 1, 2) join {notices} n using (notice_id) join {contractors} using (contractor_id)""")
def reasoning_requests(t):
    scored = t.scores.groupBy("contractor_id", "notice_id").agg(F.floor(F.max_by("score", "score_id")).cast("int").alias("total")) \
        .join(t.notices.select("notice_id", "title"), "notice_id").join(t.contractors.select("contractor_id", "company_name"), "contractor_id")
    return rt.reasoning_requests(scored.withColumn("factor_lines", F.array(F.concat(F.lit("- timing: "), F.col("total").cast("string")), F.lit("- goals: 0"))))


@query("requirement_requests", f"select notice_id, 'RFP: ' || title || chr(10) || chr(10) || '## Description' || chr(10) || substr({_S.format('description')}, 1, 12000) as request from {{notices}} where trim(description) <> ''")
def requirement_requests(t):
    return rt.requirement_requests(t.notices)


@query("prereq_requests", f"""select contractor_id, notice_id, 'RFP: ' || title || chr(10) || chr(10) || '## Requirements to evaluate' || chr(10) || '1. Hold ' || n.naics_codes[1] || chr(10) || '2. Hold ' || n.naics_codes[2] || chr(10) || chr(10) || '## Contractor profile' || chr(10)
 || 'Certifications held: ' || array_to_string(certifications, ', ') || chr(10) || 'Set-aside eligibility: ' || array_to_string(set_aside_eligibility, ', ') || chr(10) || 'Industries: ' || array_to_string(industries, ', ') || chr(10) || 'Sub-industries: ' || array_to_string(sub_industries, ', ')
 || chr(10) || chr(10) || '## Past projects' || chr(10) || coalesce(p, '(none)') as request from {{saved}} s join {{notices}} n using (notice_id) join {{contractors}} c using (contractor_id)
 left join (select contractor_id, string_agg('### Past project ' || rank || ': ' || project_name || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || coalesce(description, ''), chr(10) || chr(10) order by rank) as p from {_PAST3} group by 1) using (contractor_id)""")
def prereq_requests(t):
    needs = t.notices.select("notice_id", F.posexplode("naics_codes").alias("p", "c")).select("notice_id", (F.col("p") + 1).alias("rank"), F.concat(F.lit("Hold "), "c").alias("requirement"))
    return rt.prereq_requests(_pairs(t), needs, t.contractors, _past(t))
