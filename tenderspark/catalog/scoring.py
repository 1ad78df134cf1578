"""Scoring queries over the candidate pairs of all contractors."""

from pyspark.sql import functions as F

from tenderspark.catalog.feed import _CANDIDATES, AS_OF
from tenderspark.catalog.normalizing import _BY_LOWER
from tenderspark.catalog.registry import query
from tenderspark.fixed import AGENCY_STOPWORDS, KEYWORD_STOPWORDS, PLACE_STOPWORDS
from tenderspark.operators import feed
from tenderspark.operators import scoring as sc
from tenderspark.operators.departments import alias_table
from tenderspark.plans.score import refresh_scores, score_pairs
from tenderspark.session import stage

_PAIRS = "(select contractor_id, notice_id from {saved} where notice_id in (select notice_id from {notices}) and contractor_id in (select contractor_id from {contractors}) union select contractor_id, notice_id from " + _CANDIDATES.replace("{cap}", "100") + ")"
_ROWS = f"""(select contractor_id, notice_id, n.*exclude (notice_id, naics_codes), c.* exclude (contractor_id, naics_codes), n.naics_codes as required_codes, c.naics_codes as held_codes
 from {_PAIRS} join {{notices}} n using (notice_id) join {{contractors}} c using (contractor_id))""".replace("n.*exclude", "n.* exclude")


def _list(ws):
    return "[" + ", ".join("'" + w + "'" for w in ws) + "]"


def _lots(t):
    """Saved notices of every contractor and the first 100 unscored ones of the feed, a contractor's together."""
    ready = feed.has_signal(t.contractors, t.past_projects)
    kept = t.saved.select("contractor_id", "notice_id").join(t.notices.select("notice_id"), "notice_id", "left_semi").join(t.contractors.select("contractor_id"), "contractor_id", "left_semi")
    return feed.candidate_pairs(ready, feed.base_feed(t.notices), t.scores, 100, kept.select("contractor_id", "notice_id").distinct())


def _pairs(t):
    """`_lots`, staged once."""
    return stage(_lots(t), "pairs")


def _inputs(t):
    return sc.pair_inputs(_pairs(t), t.contractors, t.notices)


def _rows(t, *columns):
    """The pairs with their short columns (all, or those that a factor reads), staged."""
    rows = _inputs(t)
    return stage(rows.select(*sc.PAIR, *columns) if columns else rows, "pair-rows")


def _judgements(t):
    numbered = lambda prefix, n: F.transform(F.filter(F.sequence(F.lit(0), F.col(n)), lambda i: i > 0), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    return t.judgements.withColumn("met", numbered("met ", "n_met")).withColumn("unmet", numbered("unmet ", "n_unmet"))


_BLOB = "(select notice_id, lower(concat_ws(' ', title, coalesce(description, ''), array_to_string(tags, ' '))) as txt from {notices} where notice_id in (select notice_id from " + _PAIRS + "))"
_MATCH = "regexp_matches(txt, '(?:^|[^a-z0-9])' || regexp_escape(term) || '(?:$|[^a-z0-9])')"
_EXTERMS = "(select contractor_id, lower(trim(x)) as term, pos from (select contractor_id, unnest(exclusions) as x, unnest(range(len(exclusions))) as pos from {contractors}) where length(trim(x)) > 1)"
_EXCLUDED = f"""(with ex as {_EXTERMS}, b as {_BLOB}, h as (select notice_id, term from b, (select distinct term from ex) where {_MATCH})
 select contractor_id, notice_id, arg_min(term, pos) as term from {_PAIRS} join ex using (contractor_id) join h using (notice_id, term) group by 1, 2)"""


@query("exclusion_gate", f"select contractor_id, notice_id, term is not null as excluded, term from {_PAIRS} left join {_EXCLUDED} using (contractor_id, notice_id)")
def exclusion_gate(t):
    return sc.exclusions(_pairs(t), t.contractors, t.notices).select("contractor_id", "notice_id", "excluded", "term")


_LEFT = f"((epoch_us(due_date) - epoch_us(timestamp '{AS_OF}')) / 86400e6)"
_TIMING = f"(select contractor_id, notice_id, due_date is null or preferred_response_window_days is null as is_null, case when due_date is null or preferred_response_window_days is null then 0 when {_LEFT} >= preferred_response_window_days then 1 else 0 end as score from {_ROWS})"


@query("timing_factor", f"select * from {_TIMING}")
def timing_factor(t):
    return sc.timing(_rows(t), AS_OF).select("contractor_id", "notice_id", "is_null", "score")


def _tok(expr, stop):
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^a-z0-9]+'), lambda w: length(w) > 2 and not list_contains({_list(stop)}, w))"


_FIRST = """list_filter(list_transform(ps, lambda p: case when contains(array_to_string(fs, ' | '), p) then 'Preferred location "' || p || '" matches RFP location.'
 when len(list_filter(fs, lambda f: contains(p, f) and length(f) > 2)) > 0 then 'RFP location "' || list_filter(fs, lambda f: contains(p, f) and length(f) > 2)[1] || '" is part of preferred area "' || p || '".' end), lambda r: r is not null)[1]"""
_SHARED = f"""list_filter({_tok("array_to_string(ps, ' ')", PLACE_STOPWORDS)}, lambda w, i: list_contains({_tok("array_to_string(fs, ' ')", PLACE_STOPWORDS)}, w) and list_position({_tok("array_to_string(ps, ' ')", PLACE_STOPWORDS)}, w) = i)"""
_GEO = f"""(select contractor_id, notice_id, case when len(ps) = 0 or len(fs) = 0 then 'Skipped: contractor has no preferred locations or RFP has no state/location.' when list_has_any(ps, ['federal', 'nationwide', 'any', '*']) then 'Contractor accepts federal / nationwide opportunities.'
 when {_FIRST} is not null then {_FIRST} when len({_SHARED}) > 0 then 'Partial location overlap on: ' || array_to_string({_SHARED}, ', ') || '.'
 else 'RFP location (' || array_to_string(fs, ' / ') || ') not in contractor''s preferred areas (' || array_to_string(ps, ', ') || ').' end as reason,
 len(ps) = 0 or len(fs) = 0 as is_null, case when len(ps) = 0 or len(fs) = 0 then 0 when list_has_any(ps, ['federal', 'nationwide', 'any', '*']) then 100
 when len(list_filter(ps, lambda p: contains(array_to_string(fs, ' | '), p) or len(list_filter(fs, lambda f: contains(p, f) and length(f) > 2)) > 0)) > 0 then 100
 when list_has_any({_tok("array_to_string(ps, ' ')", PLACE_STOPWORDS)}, {_tok("array_to_string(fs, ' ')", PLACE_STOPWORDS)}) then 60 else 0 end as score
 from (select contractor_id, notice_id, list_filter(list_transform(preferred_locations, lambda x: lower(trim(x))), lambda x: x <> '') as ps, list_filter([lower(trim(coalesce(state, ''))), lower(trim(coalesce(location, '')))], lambda x: x <> '') as fs from {_ROWS}))"""


@query("geography_factor", f"select * from {_GEO}")
def geography_factor(t):
    return sc.geography(_rows(t)).select("contractor_id", "notice_id", "is_null", "score", "reason")


_KTERMS = f"(select contractor_id, lower(trim(x)) as term, min((kind, project, i)) as place from (select contractor_id, unnest(list_concat(industries, sub_industries)) as x, 1 as kind, 0 as project, unnest(range(len(industries) + len(sub_industries))) as i from {{contractors}} union all select contractor_id, unnest(tags), 0, project_id, unnest(range(len(tags))) from {{past_projects}}) where length(trim(x)) > 1 and not list_contains({_list(KEYWORD_STOPWORDS)}, lower(trim(x))) group by 1, 2)"
_KEY = f"""(with kt as {_KTERMS}, b as {_BLOB}, h as (select notice_id, term from b, (select distinct term from kt) where {_MATCH}), n as (select contractor_id, count(*) as total from kt group by 1),
 m as (select contractor_id, notice_id, count(*) as c, string_agg(term, '|' order by place) as matched from {_PAIRS} join kt using (contractor_id) join h using (notice_id, term) group by 1, 2)
 select contractor_id, notice_id, total is null as is_null, coalesce(matched, '') as matched, coalesce(cast(least(100, floor(coalesce(c, 0) / total * 250 + 0.5)) as int), 0) as score,
 case when total is null then 'Skipped: contractor has no tags / industries / sub-industries on file.' when c is null then 'No contractor industries or tags appear in this RFP.' else 'Matched ' || c || ' of ' || total || ' contractor terms in RFP text/tags.' end as reason
 from {_PAIRS} left join n using (contractor_id) left join m using (contractor_id, notice_id))"""


@query("keyword_factor", f"select * from {_KEY}")
def keyword_factor(t):
    return sc.keywords(_pairs(t), t.contractors, t.past_projects, t.notices).select("contractor_id", "notice_id", "is_null", F.array_join("matched_terms", "|").alias("matched"), "score", "reason")


def _canon(table, column, out):
    return f"(select distinct {column}, coalesce(canonical_name, trim({column})) as {out} from (select distinct {column} from {table}) left join {_BY_LOWER} on la = lower(trim({column})))"


_AGENCY = f"""(with cl as (select distinct contractor_id, client_name from (select contractor_id, trim(client) as client from {{past_projects}} where trim(client) <> '') join {_canon("(select trim(client) as client from {past_projects} where client is not null)", "client", "client_name")} using (client)),
 dp as (select * from {_canon("{notices}", "department", "dept_name")} where department is not null),
 ti as (select contractor_id, department, client_name, case when lower(dept_name) = lower(client_name) then 100
   when (length(client_name) > 4 and contains(lower(dept_name), lower(client_name))) or (length(dept_name) > 4 and contains(lower(client_name), lower(dept_name))) then 70
   when len(list_intersect(list_distinct({_tok('dept_name', AGENCY_STOPWORDS)}), list_distinct({_tok('client_name', AGENCY_STOPWORDS)}))) >= 2 then 40 else 0 end as tier
   from (select distinct contractor_id, department from {_ROWS}) join dp using (department) join cl using (contractor_id)),
 be as (select contractor_id, department, max(tier) as score, string_agg(client_name, '|' order by client_name) filter (tier = mx) as names from (select *, max(tier) over (partition by contractor_id, department) as mx from ti) group by 1, 2)
 select contractor_id, notice_id, score is null as is_null, coalesce(score, 0) as score, case when score > 0 then names else '' end as matched from (select contractor_id, notice_id, department from {_ROWS}) left join be using (contractor_id, department))"""


@query("agency_factor", f"select * from {_AGENCY}")
def agency_factor(t):
    return sc.agency(_rows(t, "department"), t.past_projects, alias_table(t.spark)).select("contractor_id", "notice_id", "is_null", "score", F.array_join("matched_clients", "|").alias("matched"))


_CODE = f"""(select contractor_id, notice_id, i, req, arg_max(struct_pack(s := s, h := h), struct_pack(s := s, p := -j)) as best from (
 select contractor_id, notice_id, i, req, j, h, case when req = h then 1.0 when substr(req, 1, 4) = substr(h, 1, 4) then 0.6 when substr(req, 1, 2) = substr(h, 1, 2) then 0.3 else 0.0 end::double as s from (
  select contractor_id, notice_id, i, req, unnest(held_codes) as h, unnest(range(len(held_codes))) as j from (select contractor_id, notice_id, held_codes, unnest(required_codes) as req, unnest(range(len(required_codes))) as i from {_ROWS}))) group by 1, 2, 3, 4)"""


@query("code_matches", f"select contractor_id, notice_id, req as required, best.s as score, case when best.s > 0 then best.h else '' end as held, case best.s when 1 then 'exact' when 0.6::double then 'industry-group' when 0.3::double then 'sector' else 'none' end as level from {_CODE}")
def code_matches(t):
    rows = _rows(t).select("contractor_id", "notice_id", F.explode(sc.code_matches(F.col("required_codes"), F.col("held_codes"))).alias("m"))
    return rows.select("contractor_id", "notice_id", "m.required", "m.score", "m.held", "m.level")


_STRUCT = f"""(select contractor_id, notice_id, concat_ws(' ', re, rg, rs, rn, case when ok then 'Eligible for ' || w || ' set-aside.' when w <> '' then 'Not certified for ' || w || ' set-aside.' end) as reasons, concat_ws('|', ce, cg, case when ok then 'Set-aside eligible: ' || w end) as met, concat_ws('|', cs, cn, case when w <> '' and not ok then 'Set-aside requires ' || w || '; contractor not certified.' end) as unmet,
 (case when ce is null then 0 else 1 end + case when cg is null then 0 else 1 end + case when ok then 1 else 0 end) as n_met, 1 + case when w <> '' then 1 else 0 end as structured
 from (select contractor_id, notice_id, trim(coalesce(set_aside, '')) as w, trim(coalesce(set_aside, '')) <> '' and list_contains(list_transform(set_aside_eligibility, lambda e: lower(e)), lower(trim(set_aside))) as ok from {_ROWS})
 join (select contractor_id, notice_id, 'NAICS exact match: ' || string_agg(req, ', ' order by i) filter (best.s = 1) as ce, 'NAICS industry-group match: ' || string_agg(req || '~' || best.h, ', ' order by i) filter (best.s = 0.6::double) as cg,
  'NAICS sector-only match (2-digit): ' || string_agg(req || '~' || best.h, ', ' order by i) filter (best.s = 0.3::double) as cs, 'NAICS not held: ' || string_agg(req, ', ' order by i) filter (best.s = 0) || '.' as cn,
  'Matches NAICS ' || string_agg(req, ', ' order by i) filter (best.s = 1) || '.' as re, 'Adjacent NAICS match (4-digit) for ' || string_agg(req, ', ' order by i) filter (best.s = 0.6::double) || '.' as rg,
  'Only broad sector overlap on NAICS ' || string_agg(req, ', ' order by i) filter (best.s = 0.3::double) || '.' as rs, 'Missing NAICS ' || string_agg(req, ', ' order by i) filter (best.s = 0) || '.' as rn from {_CODE} group by 1, 2) using (contractor_id, notice_id))"""


@query("structured_prereqs", f"select contractor_id, notice_id, met, unmet, cast(structured as int) as structured from {_STRUCT}".replace("list_contains(list_transform(set_aside_eligibility, lambda e: lower(e)), lower(trim(set_aside)))", "coalesce(list_contains(list_transform(set_aside_eligibility, lambda e: lower(e)), lower(trim(set_aside))), false)"))
def structured_prereqs(t):
    return sc.structured_prereqs(_rows(t)).select("contractor_id", "notice_id", F.array_join("met", "|").alias("met"), F.array_join("unmet", "|").alias("unmet"), "structured")


_STRUCT_OK = _STRUCT.replace("list_contains(list_transform(set_aside_eligibility, lambda e: lower(e)), lower(trim(set_aside)))", "coalesce(list_contains(list_transform(set_aside_eligibility, lambda e: lower(e)), lower(trim(set_aside))), false)")
_PREREQ = f"""(select contractor_id, notice_id, met, unmet, structured + coalesce(n_met_ + n_unmet_, 0) as total, n_met_, n_unmet_, concat_ws(' ', nullif(reasons, ''), why) as reason, false as is_null, cast(floor(least(n_met + coalesce(j.n_met_, 0), structured + coalesce(j.n_met_ + j.n_unmet_, 0)) / (structured + coalesce(j.n_met_ + j.n_unmet_, 0)) * 100 + 0.5) as int) as score
 from {_STRUCT_OK} left join (select contractor_id, notice_id, n_met as n_met_, n_unmet as n_unmet_, reason as why from {{judgements}} where factor = 'prereqs') j using (contractor_id, notice_id))"""


@query("prereq_factor", f"select contractor_id, notice_id, is_null, score, reason, cast(total as int) as total from {_PREREQ}")
def prereq_factor(t):
    return sc.prereqs(_inputs(t), _judgements(t)).select("contractor_id", "notice_id", "is_null", "score", "reason", "total")


@query("prereq_factor_by_requirements", f"""select contractor_id, notice_id, cast(structured + case when n_met_ is null then 0 else 3 end as int) as total,
 cast(floor(least(n_met + coalesce(n_met_, 0), structured + case when n_met_ is null then 0 else 3 end) / (structured + case when n_met_ is null then 0 else 3 end) * 100 + 0.5) as int) as score
 from {_STRUCT_OK} left join (select contractor_id, notice_id, n_met as n_met_ from {{judgements}} where factor = 'prereqs') using (contractor_id, notice_id)""")
def prereq_factor_by_requirements(t):
    """The denominator is what was asked of the judge, three requirements here, whatever the reply lists."""
    asked = t.notices.select("notice_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    return sc.prereqs(_rows(t), _judgements(t), asked).select("contractor_id", "notice_id", "total", "score")


_EXP = f"""(select contractor_id, notice_id, case when w.names is null or j.score is null then '' else w.names end as matched, w.names is not null and j.score is null as is_null, case when w.names is null then 0 else coalesce(j.score, 0) end as score from {_PAIRS} p
 left join (select contractor_id, string_agg(project_name, '|' order by project_id) as names from (select * from {{past_projects}} qualify row_number() over (partition by contractor_id order by project_id) <= 5) group by 1) w using (contractor_id) left join (select contractor_id, notice_id, score from {{judgements}} where factor = 'experience') j using (contractor_id, notice_id))"""


@query("experience_factor", f"select * from {_EXP}")
def experience_factor(t):
    return sc.experience(_lots(t), t.past_projects, _judgements(t)).select("contractor_id", "notice_id", "is_null", "score", F.array_join("matched_past_projects", "|").alias("matched"))


_GOAL = f"""(select contractor_id, notice_id, trim(coalesce(goals, '')) = '' or j.score is null as is_null, case when trim(coalesce(goals, '')) = '' then 0 else coalesce(j.score, 0) end as score from {_ROWS}
 left join (select contractor_id, notice_id, score from {{judgements}} where factor = 'goals') j using (contractor_id, notice_id))"""


@query("goals_factor", f"select * from {_GOAL}")
def goals_factor(t):
    return sc.goals(_rows(t), _judgements(t)).select("contractor_id", "notice_id", "is_null", "score")


_PARTS = {"timing": _TIMING, "experience": _EXP, "goals": _GOAL, "prereqs": _PREREQ, "geography": _GEO, "agency": _AGENCY, "keywords": _KEY}
_JOINED = f"(select contractor_id, notice_id, x.term is not null as excluded, x.term as excluded_term, " + ", ".join(f"{f}.score as {f}, {f}.is_null as {f}_null" for f in sc.FACTORS) + f" from {_PAIRS} left join {_EXCLUDED} x using (contractor_id, notice_id) " + \
    " ".join(f"join {_PARTS[f]} as {f} using (contractor_id, notice_id)" for f in sc.FACTORS) + ")"
_ACTIVE = "(" + " + ".join(f"case when {f}_null then 0 else 1 end" for f in sc.FACTORS) + ")"
_SUM = " + ".join(f"{f} / {'1.0' if f == 'timing' else '100.0'}::double * case when a = 0 then 1.0::double / 7 when {f}_null then 0 else 1.0::double / a end" for f in sc.FACTORS)
_TOTAL = f"(select *, cast(case when excluded then 0 else floor((0.0::double + {_SUM}) * 100 + 0.5) end as int) as total from (select *, {_ACTIVE} as a from {_JOINED}))"


@query("pair_scores", f"""select contractor_id, notice_id, excluded_term, {', '.join(sc.FACTORS)}, total, concat_ws(',', {', '.join(f"case when {f}_null then '{f}' end" for f in sc.FACTORS)}) as null_factors,
 case when excluded then 'Excluded: RFP mentions "' || excluded_term || '" which is on the contractor''s no-go list.' else 'Compatibility ' || total || '/100. {'; '.join(f"{f}: ' || {f} || '" for f in sc.FACTORS)}.' end as reasoning, 'compat-v2' as model_version from {_TOTAL}""")
def pair_scores(t):
    scored = score_pairs(_pairs(t), t.contractors, t.notices, t.past_projects, alias_table(t.spark), _judgements(t), AS_OF)
    return scored.select("contractor_id", "notice_id", "excluded_term", *sc.FACTORS, "total", F.array_join("null_factors", ",").alias("null_factors"), "reasoning", "model_version")


@query("factor_weights", f"select contractor_id, notice_id, " + ", ".join(f"round(case when a = 0 then 1.0::double / 7 when {f}_null then 0 else 1.0::double / a end, 9) as w_{f}" for f in sc.FACTORS) + f" from (select *, {_ACTIVE} as a from (select contractor_id, notice_id, " + ", ".join(f"{f}.is_null as {f}_null" for f in ("timing", "geography")) + ", false as experience_null, true as goals_null, false as prereqs_null, true as agency_null, true as keywords_null from " + _TIMING + " timing join " + _GEO + " geography using (contractor_id, notice_id)))")
def factor_weights(t):
    rows = _rows(t)
    known = sc.timing(rows, AS_OF).select(*sc.PAIR, F.col("is_null").alias("timing_null")).join(sc.geography(rows).select(*sc.PAIR, F.col("is_null").alias("geography_null")).hint("merge"), sc.PAIR)
    for f, null in (("experience", False), ("goals", True), ("prereqs", False), ("agency", True), ("keywords", True)):
        known = known.withColumn(f"{f}_null", F.lit(null))
    return sc.weights(known).select(*sc.PAIR, *[F.round(f"w_{f}", 9).alias(f"w_{f}") for f in sc.FACTORS])


_FRESH = "(select contractor_id, notice_id from " + _CANDIDATES.replace("{cap}", "100") + ")"
_OLD = "(select contractor_id, notice_id, arg_max(score, score_id) as score, max(computed_at) as computed_at from {scores} group by 1, 2)"
_W = ", ".join(f"case when a = 0 then 1.0::double / 7 when {f}_null then 0 else 1.0::double / a end" for f in sc.FACTORS)


@query("refreshed_scores", f"""with fresh as (select x.*, geography.reason as geo_reason, keywords.matched as terms, keywords.reason as key_reason, agency.matched as clients, prereqs.reason as pre_reason, prereqs.total as pre_total, experience.matched as projects
   from {_TOTAL} x join {_FRESH} using (contractor_id, notice_id) join {_GEO} geography using (contractor_id, notice_id) join {_KEY} keywords using (contractor_id, notice_id) join {_AGENCY} agency using (contractor_id, notice_id)
   join {_PREREQ} prereqs using (contractor_id, notice_id) join {_EXP} experience using (contractor_id, notice_id)),
 merged as (select contractor_id, notice_id, coalesce(f.total::double, o.score) as score, case when f.total is not null then timestamp '{AS_OF}' else o.computed_at end as computed_at, case when f.total is null then 'old' else 'compat-v2' end as model_version,
   {', '.join(f"f.{c}" for c in ("geo_reason", "terms", "key_reason", "clients", "pre_reason", "excluded_term"))}, cast(f.pre_total as int) as pre_total, f.projects, case when f.total is not null then concat_ws(',', {', '.join(f"case when f.{c}_null then '{c}' end" for c in sc.FACTORS)}) end as null_factors,
   case when f.total is not null then round(list_sum([{_W}]), 6) end as weight_sum, f.timing as timing_score, f.total as kept_total from {_OLD} o full join fresh f using (contractor_id, notice_id))
 select * from merged qualify row_number() over (partition by contractor_id order by computed_at desc, notice_id desc) <= 100""")
def refreshed_scores(t):
    """The whole refresh: the first 100 unscored notices of every contractor scored, their breakdown stored beside the cached scores, the newest 100 kept."""
    cached = t.scores.groupBy("contractor_id", "notice_id").agg(F.max_by("score", "score_id").alias("score"), F.max("computed_at").alias("computed_at"))
    cached = cached.withColumns({"model_version": F.lit("old"), "reasoning": F.lit(None).cast("string")})
    done = refresh_scores(t.contractors, t.notices, t.past_projects, alias_table(t.spark), _judgements(t), cached, AS_OF)
    f = F.col("factors.factors")
    weights = [F.col("factors.weights")[c] for c in sc.FACTORS]
    return done.select(
        *sc.PAIR, "score", "computed_at", "model_version", f["geography"]["reason"].alias("geo_reason"), F.array_join(f["keywords"]["matched_terms"], "|").alias("terms"), f["keywords"]["reason"].alias("key_reason"),
        F.array_join(f["agency"]["matched_clients"], "|").alias("clients"), f["prereqs"]["reason"].alias("pre_reason"), F.col("factors.excluded.term").alias("excluded_term"), f["prereqs"]["total"].alias("pre_total"),
        F.array_join(f["experience"]["matched_past_projects"], "|").alias("projects"), F.array_join("factors.null_factors", ",").alias("null_factors"), F.round(sum(weights[1:], weights[0]), 6).alias("weight_sum"),
        f["timing"]["score"].alias("timing_score"), F.col("factors.total").alias("kept_total"))
