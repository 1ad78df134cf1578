"""Table maintenance queries over the whole derived tables."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.catalog.tables import TABLES
from tenderspark.operators import maintenance as op
from tenderspark.operators.feed import latest_views

KEYS = ["source", "external_id"]
FIELDS = ["title", "department", "due_date"]
NOW = "2024-02-01 00:00:00"

# Two snapshots of the notice table: closed notices left the portal, amended ones are new.
TABLES["old_snapshot"] = """select n.source, n.external_id, n.title, n.name, n.department, cast(n.due_date as date) as due_date, n.tags, n.deliverables, n.status, n.content_hash,
 timestamp '2024-01-01 00:00:00' as updated_at from {notices} n where n.status <> 'amended'"""
TABLES["new_snapshot"] = """select n.source, case when n.location is null and n.amount_min is null then '' else n.external_id end as external_id,
 case when n.notice_id % 5 = 0 then n.title || ' (rev)' else n.title end as title, n.name,
 case when n.notice_id % 4 = 0 then cast(null as string) else n.department end as department, cast(n.due_date as date) as due_date,
 case when n.notice_id % 6 = 0 then NULLARR else n.tags end as tags, n.deliverables, n.status,
 case when n.notice_id % 5 = 0 then n.content_hash || 'x' else n.content_hash end as content_hash from {notices} n where n.status <> 'closed'"""
TABLES["saved_base"] = """select c.c_custkey as contractor_id, c.c_custkey % 40 as notice_id, timestamp '2023-12-01 00:00:00' as saved_at,
 cast(c.c_custkey % 5 as int) as sort_position, 'base note' as notes, 'pursuing' as bid_status from {customer} c"""
TABLES["saved_changes"] = """select e.event_id as change_id, e.user_id as contractor_id, e.event_id % 40 as notice_id,
 case e.event_type when 'purchase' then 'save' when 'error' then 'unsave' when 'view' then 'note' when 'signup' then 'save' else 'status' end as kind,
 case when e.event_type = 'view' then case when e.event_id % 3 = 0 then '  ' else ' note ' || cast(e.event_id as string) end
      when e.event_type = 'click' then case e.event_id % 3 when 0 then 'submitted' when 1 then 'no_bid' else 'pursuing' end end as value, e.ts from {events} e"""

_NEW = "(select * from {new_snapshot} where external_id <> '')"
_LIST = "array_to_string({0}, '|')"


@query("skip_existing", """select external_id, title from {new_snapshot} where coalesce(nullif(trim(external_id, '._'), ''), 'notice') not in
 (select external_id from {old_snapshot})""")
def skip_existing(t):
    return op.skip_existing(t.new_snapshot, t.old_snapshot, "external_id").select("external_id", "title")


@query("first_arrival_wins", """select user_id, event_type, event_id, value from {events_t} qualify row_number() over (partition by user_id, event_type order by event_id) = 1"""
       .replace("{events_t}", "events"))
def first_arrival_wins(t):
    return op.first_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("notice_rows", """select external_id, department, case when location = 'California' or location_level = 'state' then 'California' end as state, posted_date, status, pdf_url_1, pdf_url_2, pdf_url_3, 'x' || notice_id as odd, notice_id as rank, external_id as raw_id
 from (select notice_id, external_id, dept as department, location, case when notice_id % 2 = 0 then 'state' else 'city' end as location_level, due_date as posted_date, coalesce(st, 'active') as status,
  case when notice_id % 3 <> 0 then 'u' || notice_id else 'v' || notice_id end as pdf_url_1, case when notice_id % 3 <> 0 then 'v' || notice_id end as pdf_url_2, cast(null as varchar) as pdf_url_3
  from (select *, department as dept, nullif(status, 'closed') as st from {notices}))""")
def notice_rows(t):
    ident = F.col("notice_id").cast("string")
    url = lambda c: F.struct(c.alias("url"))
    docs = F.array(url(F.when(F.col("notice_id") % 3 != 0, F.concat(F.lit("u"), ident)).otherwise("")), url(F.concat(F.lit("v"), ident)))
    none = F.lit(None).cast("string")
    processed = t.notices.select(
        "source", "external_id", "title", "name", "statement_of_work", "deliverables", "description", "location",
        F.when(F.col("notice_id") % 2 == 0, "state").otherwise("city").alias("location_level"), F.col("department").alias("dept"),
        "due_date", F.col("due_date").alias("published_date"), "tags", "is_relevant", none.alias("contact_name"), none.alias("contact_email"),
        none.alias("contact_phone"), "content_hash", F.nullif("status", F.lit("closed")).alias("status"), docs.alias("documents"),
        F.to_json(F.struct(F.struct(F.concat(F.lit("x"), ident).alias("odd")).alias("portal"))).alias("metadata_json"), F.to_json(F.struct(F.col("notice_id").alias("rank"))).alias("extra"))
    # `odd` and `rank` stand under keys that no schema lists.
    return op.to_notice_row(processed).select(
        "external_id", "department", "state", "posted_date", "status", "pdf_url_1", "pdf_url_2", "pdf_url_3", F.get_json_object("metadata", "$.portal.odd").alias("odd"),
        F.get_json_object("raw_data", "$.rank").cast("long").alias("rank"), F.get_json_object("raw_data", "$.external_id").alias("raw_id"))


_MERGED = f"""(select coalesce(o.source, n.source) as source, coalesce(o.external_id, n.external_id) as external_id, coalesce(n.title, o.title) as title,
 coalesce(n.name, o.name) as name, coalesce(n.department, o.department) as department, coalesce(n.due_date, o.due_date) as due_date,
 case when n.external_id is not null then n.tags else o.tags end as tags, coalesce(n.status, o.status) as status, coalesce(n.content_hash, o.content_hash) as content_hash,
 case when n.external_id is not null and (o.external_id is null or (coalesce(n.title, o.title), coalesce(n.name, o.name), coalesce(n.department, o.department), n.tags, n.status, n.content_hash)
  is distinct from (o.title, o.name, o.department, o.tags, o.status, o.content_hash)) then timestamp '{NOW}' else o.updated_at end as updated_at
 from {{old_snapshot}} o full join {_NEW} n on o.source = n.source and o.external_id = n.external_id)"""


def _merge(t):
    return op.merge_sparse(t.old_snapshot, t.new_snapshot, KEYS, overwrite=["tags", "deliverables"],
                           order=[F.col("content_hash")], touch=("updated_at", F.lit(NOW).cast("timestamp")))


@query("merge_sparse", f"select * exclude (tags), {_LIST.format('tags')} as tags from {_MERGED}")
def merge_sparse(t):
    return _merge(t).drop("deliverables").withColumn("tags", F.array_join("tags", "|"))


_CHANGES = " || ".join(f"case when cast(o.{f} as varchar) is distinct from cast(n.{f} as varchar) then '{f}:' || coalesce(cast(o.{f} as varchar), '-') || '>' || coalesce(cast(n.{f} as varchar), '-') || ';' else '' end"
                       for f in FIELDS)
_AMENDED = f"(select n.source, n.external_id, o.content_hash as old_hash, n.content_hash as new_hash, {_CHANGES} as changes from {{old_snapshot}} o join {_NEW} n using (source, external_id) where o.content_hash <> n.content_hash)"


@query("amendment_records", f"select * from {_AMENDED}")
def amendment_records(t):
    text = F.array_join(F.transform(F.map_entries("changes"), lambda e: F.concat(
        e["key"], F.lit(":"), F.coalesce(e["value"]["old"], F.lit("-")), F.lit(">"), F.coalesce(e["value"]["new"], F.lit("-")), F.lit(";"))), "")
    return op.amendments(t.old_snapshot, t.new_snapshot, KEYS, FIELDS).withColumn("changes", text)


@query("amended_table", f"""select m.source, m.external_id, case when a.external_id is not null then 'amended' else m.status end as status, m.content_hash,
 case when a.external_id is not null then timestamp '{NOW}' end as last_amended_at from {_MERGED} m left join {_AMENDED} a using (source, external_id)""")
def amended_table(t):
    found = op.amendments(t.old_snapshot, t.new_snapshot, KEYS, FIELDS)
    return op.apply_amendments(_merge(t), found, KEYS, F.lit(NOW).cast("timestamp")) \
        .select("source", "external_id", "status", "content_hash", "last_amended_at")


@query("keep_newest_scores", "select contractor_id, notice_id, score_id from {scores} qualify row_number() over (partition by contractor_id order by computed_at desc, score_id desc) <= 100")
def keep_newest_scores(t):
    return op.keep_newest(t.scores, "contractor_id", "computed_at", "score_id", 100).select("contractor_id", "notice_id", "score_id")


@query("score_freshness", "select score_id, computed_at >= updated_at as fresh from {scores} join {contractors} using (contractor_id)")
def score_freshness(t):
    return op.split_fresh(t.scores, t.contractors).select("score_id", "fresh")


@query("purge_stale_summaries", "select summary_id, summary_type, prompt_version from {summaries} where not (summary_type = 'general' and prompt_version is distinct from 'detailed-v4')")
def purge_stale_summaries(t):
    return op.purge_stale(t.summaries, "general", "detailed-v4").select("summary_id", "summary_type", "prompt_version")


def _rules():
    return {"score_range": F.col("score").between(0, 60), "known_version": F.col("model_version").isin("compat-v2"),
            "has_reason": F.col("reasoning").rlike("^r[0-9]+$")}


@query("quality_report", """select 'score_range' as rule, count(*) filter (score not between 0 and 60) as bad from {scores}
 union all select 'known_version', count(*) filter (model_version not in ('compat-v2')) from {scores} union all select 'has_reason', count(*) filter (not regexp_matches(reasoning, '^r[0-9]+$')) from {scores}""")
def quality_report(t):
    return op.quality_report(t.scores, _rules())


@query("quarantined_scores", "select score_id from {scores} where score not between 0 and 60 or model_version not in ('compat-v2')")
def quarantined_scores(t):
    return op.quarantine(t.scores, _rules())[1].select("score_id")


@query("duplicate_score_keys", "select contractor_id, notice_id, count(*) as n from {scores} group by 1, 2 having count(*) > 1")
def duplicate_score_keys(t):
    return op.duplicate_keys(t.scores, ["contractor_id", "notice_id"])


@query("latest_view", "select contractor_id, notice_id, max(viewed_at) as viewed_at from {views} group by 1, 2")
def latest_view(t):
    return latest_views(t.views)


_PROFILES = """(select c_custkey as contractor_id, case when c_custkey % 3 = 0 then '  ' else ' Worked on ' || c_mktsegment || ' ' end as past_experience,
 'Acme; ' || c_mktsegment || ', ACME' || chr(10) || ' ,' || lower(c_mktsegment) as past_clients from {customer} where c_acctbal > 0)"""


@query("replace_past_projects", "select contractor_id, project_name, description, client from {past_projects} where contractor_id not in (select contractor_id from " + _PROFILES + """ )
 union all select contractor_id, 'Experience profile', trim(past_experience), null from """ + _PROFILES + """ where trim(past_experience) <> ''
 union all select contractor_id, u, null, u from (select contractor_id, unnest(['Acme', string_split(past_clients, ', ')[1][7:]]) as u from """ + _PROFILES + ")")
def replace_past_projects(t):
    profiles = t.spark.sql("select * from " + _PROFILES, customer=t.customer)
    return op.replace_children(t.past_projects, profiles)


_FORM = """(select c_custkey as contractor_id, c_mktsegment || ', x;' || chr(10) || ' y ' as industries, '' as sub_industries, case when c_custkey % 2 = 0 then '' else 'g' end as goals,
 ' , ' as preferred_locations, case c_custkey % 3 when 0 then ' 12.5 ' when 1 then 'abc' else '' end as contract_min, '1e3' as contract_max,
 case c_custkey % 2 when 0 then '7.9' else '-3' end as window_days, '541512,541511' as naics_codes, 'a;b' as exclusions from {customer})"""


@query("profile_form", """select contractor_id, trim(string_split(industries, ',')[1]) || '|x|y' as industries, '' as sub_industries, nullif(goals, '') as goals, '' as preferred_locations,
 try_cast(nullif(trim(contract_min), '') as double) as preferred_contract_min, 1000.0::double as preferred_contract_max, case when window_days = '7.9' then 7 else -3 end as preferred_response_window_days,
 '541512|541511' as naics_codes, 'a|b' as exclusions from """ + _FORM)
def profile_form(t):
    out = op.profile_to_contractor(t.spark.sql("select * from " + _FORM, customer=t.customer))
    for name in ("industries", "sub_industries", "preferred_locations", "naics_codes", "exclusions"):
        out = out.withColumn(name, F.array_join(name, "|"))
    return out


_CACHE = """(select source, external_id, content_hash, case when status = 'closed' then '' else title end as description, name as statement_of_work from {old_snapshot})"""


@query("summary_cache_hits", """select source, external_id, coalesce(n.content_hash = c.content_hash and c.description <> '' and c.statement_of_work <> '', false) as hit from """
       + _NEW + " n left join " + _CACHE + " c using (source, external_id)")
def summary_cache_hits(t):
    cache = t.old_snapshot.select("source", "external_id", "content_hash",
                                  F.when(F.col("status") == "closed", "").otherwise(F.col("title")).alias("description"), F.col("name").alias("statement_of_work"))
    return op.cache_split(t.new_snapshot.filter("external_id <> ''"), cache, KEYS, ["description", "statement_of_work"]).select("source", "external_id", "hit")


_SUM_BASE = "(select notice_id, summary_type, prompt_version, max(summary) as summary, max(generated_at) as generated_at from {summaries} where prompt_version is not null group by 1, 2, 3)"


@query("summary_upsert", f"""with b as {_SUM_BASE}, n as (select notice_id % 500 as notice_id, 'general' as summary_type, 'detailed-v4' as prompt_version, 'new ' || cast(notice_id % 500 as varchar) as summary,
  timestamp '{NOW}' as generated_at from {{scores}} group by all)
 select notice_id, summary_type, prompt_version, coalesce(n.summary, b.summary) as summary, coalesce(n.generated_at, b.generated_at) as generated_at from b full join n using (notice_id, summary_type, prompt_version)""")
def summary_upsert(t):
    base = t.summaries.filter("prompt_version is not null").groupBy("notice_id", "summary_type", "prompt_version") \
        .agg(F.max("summary").alias("summary"), F.max("generated_at").alias("generated_at"))
    fresh = t.scores.select((F.col("notice_id") % 500).alias("notice_id")).distinct().select(
        "notice_id", F.lit("general").alias("summary_type"), F.lit("detailed-v4").alias("prompt_version"),
        F.concat(F.lit("new "), F.col("notice_id").cast("string")).alias("summary"), F.lit(NOW).cast("timestamp").alias("generated_at"))
    return op.merge_summaries(base, fresh)


@query("score_upsert", """with b as (select contractor_id, notice_id, arg_max(score, score_id) as score, max(computed_at) as computed_at from {scores} where model_version = 'compat-v1' group by 1, 2),
 n as (select contractor_id, notice_id, arg_max(score, score_id) as score, max(computed_at) as computed_at from {scores} where model_version = 'compat-v2' group by 1, 2)
 select contractor_id, notice_id, coalesce(n.score, b.score) as score, coalesce(n.computed_at, b.computed_at) as computed_at from b full join n using (contractor_id, notice_id)
 qualify row_number() over (partition by contractor_id order by coalesce(n.computed_at, b.computed_at) desc, notice_id desc) <= 100""")
def score_upsert(t):
    half = lambda v: t.scores.filter(F.col("model_version") == v).groupBy("contractor_id", "notice_id").agg(
        F.max_by("score", "score_id").alias("score"), F.max("computed_at").alias("computed_at"))
    return op.merge_scores(half("compat-v1"), half("compat-v2"), keep=100)


_LOG = """(select ch.*, coalesce(last_value(case when kind in ('save', 'unsave') then kind end ignore nulls) over (partition by ch.contractor_id, ch.notice_id order by ts, change_id rows between unbounded preceding and 1 preceding) = 'save',
  b.contractor_id is not null) as saved_now, b.contractor_id is not null as held from {saved_changes} ch left join {saved_base} b using (contractor_id, notice_id))"""


@query("saved_changes_applied", f"""with lg as {_LOG},
 m as (select contractor_id, notice_id, arg_max(kind, (ts, change_id)) filter (kind in ('save', 'unsave')) as last_toggle, max((ts, change_id)) filter (kind = 'unsave') as unsaved,
   max(ts) filter (kind = 'save' and not saved_now) as inserted from lg group by 1, 2),
 e as (select lg.contractor_id, lg.notice_id, count(*) filter (kind = 'note') as n_notes, arg_max(coalesce(trim(value), ''), (ts, change_id)) filter (kind = 'note') as note,
   arg_max(value, (ts, change_id)) filter (kind = 'status') as st
   from lg join m using (contractor_id, notice_id) where kind in ('note', 'status') and saved_now and (unsaved is null or (ts, change_id) > unsaved) group by 1, 2),
 f as (select contractor_id, notice_id, b.saved_at as b_at, b.sort_position as b_pos, b.notes as b_notes, b.bid_status as b_status, last_toggle, inserted, n_notes, note, st,
   b.saved_at is not null and unsaved is null as kept from {{saved_base}} b full join m using (contractor_id, notice_id) left join e using (contractor_id, notice_id)
   where last_toggle = 'save' or (last_toggle is null and b.saved_at is not null)),
 r as (select contractor_id, notice_id, kept, case when kept then b_at else inserted end as saved_at, case when kept then b_pos end as pos,
   case when n_notes > 0 then nullif(note, '') when kept then b_notes end as notes, coalesce(st, case when kept then b_status end, 'reviewing') as bid_status from f)
 select contractor_id, notice_id, saved_at, notes, bid_status, cast(case when kept then pos else coalesce(max(case when kept then coalesce(pos, -1) end) over (partition by contractor_id), -1)
   + row_number() over (partition by contractor_id, kept order by saved_at, notice_id) end as int) as sort_position from r""")
def saved_changes_applied(t):
    return op.apply_saved_changes(t.saved_base, t.saved_changes)[0].select("contractor_id", "notice_id", "saved_at", "notes", "bid_status", "sort_position")


@query("saved_changes_rejected", f"select change_id, contractor_id, notice_id, kind from {_LOG} where kind in ('note', 'status') and not saved_now")
def saved_changes_rejected(t):
    return op.apply_saved_changes(t.saved_base, t.saved_changes)[1].select("change_id", "contractor_id", "notice_id", "kind")


@query("purge_orphan_saves", "select contractor_id, notice_id from {saved} where notice_id in (select notice_id from {notices} where status <> 'closed')")
def purge_orphan_saves(t):
    return op.purge_orphans(t.saved, t.notices.filter("status <> 'closed'"), "notice_id").select("contractor_id", "notice_id")


@query("orphan_saves", "select contractor_id, notice_id from {saved} where notice_id not in (select notice_id from {notices} where status <> 'closed')")
def orphan_saves(t):
    return op.orphans(t.saved, t.notices.filter("status <> 'closed'"), "notice_id").select("contractor_id", "notice_id")


@query("ingest_counts", "select case when source is null or external_id = '' then 'skipped' else 'upserted' end as ingest_status, count(*) as n from {new_snapshot} group by 1")
def ingest_counts(t):
    return op.ingest_counts(t.new_snapshot)
