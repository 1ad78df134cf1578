"""Feed queries over the whole derived tables."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.fixed import INDUSTRY_TAGS, TOPIC_TAGS
from tenderspark.operators import feed as op
from tenderspark.operators.ranking import rank_rows

AS_OF = "1998-06-01"

_FEED = "(select * from {notices} where status = 'active' and is_relevant)"
_DUE = "due_date asc nulls last, notice_id"
_LATEST = """(select contractor_id, notice_id, arg_max(score, struct_pack(a := computed_at, b := score_id)) as score
  from {scores} group by 1, 2)"""


def _one(n):
    return (f"case when {n} >= 1000000 then '$' || case when {n} % 1000000 = 0 then cast(cast({n} / 1000000 as bigint) as varchar)"
            f" else cast(cast(floor(floor({n} / 100000 + 0.5) / 10) as bigint) as varchar) || '.' || cast(cast(floor({n} / 100000 + 0.5) as bigint) % 10 as varchar) end || 'M'"
            f" when {n} >= 1000 then '$' || cast(cast(floor({n} / 1000 + 0.5) as bigint) as varchar) || 'K'"
            f" else '$' || cast(cast(floor({n} + 0.5) as bigint) as varchar) end")


_AMOUNT = (f"case when amount_min is null and amount_max is null then '—' when amount_min <> amount_max then {_one('amount_min')} || ' – ' || {_one('amount_max')}"
           f" else {_one('coalesce(amount_min, amount_max)')} end")
_PARSED = f"""(select *, upper(trim(regexp_replace({_AMOUNT}, '[$,]', '', 'g'))) as u from {{notices}})"""
_VALUE = """case when u like '%M' then try_cast(nullif(trim(substr(u, 1, length(u) - 1)), '') as double) * 1000000
 when u like '%K' then try_cast(nullif(trim(substr(u, 1, length(u) - 1)), '') as double) * 1000
 else coalesce(try_cast(u as double), 0) end"""


def _feed(t):
    return op.base_feed(t.notices)


@query("base_feed", f"select notice_id, title, department, location, state, due_date, array_to_string(tags, '|') as tags from {_FEED}")
def base_feed(t):
    return op.order_by_due(_feed(t).select("notice_id", "title", "department", "location", "state", "due_date",
                                           F.array_join("tags", "|").alias("tags")))


@query("base_feed_with_amended", "select notice_id, status from {notices} where status in ('active', 'amended') and is_relevant")
def base_feed_with_amended(t):
    return op.base_feed(t.notices, include_amended=True).select("notice_id", "status")


@query("latest_cached_score", "select contractor_id, notice_id, score from " + _LATEST)
def latest_cached_score(t):
    return op.latest_scores(t.scores).select("contractor_id", "notice_id", "score")


@query("current_summary_per_notice", """select notice_id, arg_max(summary, struct_pack(a := generated_at, b := summary_id)) as summary
 from {summaries} where summary_type = 'general' and prompt_version = 'detailed-v4' group by 1""")
def current_summary_per_notice(t):
    return op.current_summaries(t.summaries, "general", "detailed-v4").select("notice_id", "summary")


@query("view_model", f"""select notice_id, contractor_id, coalesce(nullif(trim(name), ''), title) as name, title,
 coalesce(department, state, '—') as agency, coalesce(strftime(due_date, '%Y-%m-%d'), '—') as due, coalesce(score, 0) as score,
 array_to_string(tags, '|') as tags, coalesce(location, '—') as location, {_AMOUNT} as contract, coalesce(description, '') as description,
 trim(coalesce(statement_of_work, '')) as statement_of_work
 from {_FEED} left join {_LATEST} using (notice_id)""")
def view_model(t):
    return op.view_model(_feed(t), t.scores).drop("due_date").withColumn("tags", F.array_join("tags", "|"))


@query("amount_text", f"select notice_id, {_AMOUNT} as contract from {{notices}}")
def amount_text(t):
    return t.notices.select("notice_id", op.format_amount(F.col("amount_min"), F.col("amount_max")).alias("contract"))


@query("amount_value", f"select notice_id, {_VALUE} as amount from {_PARSED}")
def amount_value(t):
    text = op.format_amount(F.col("amount_min"), F.col("amount_max"))
    return t.notices.select("notice_id", op.parse_amount(text).alias("amount"))


@query("feed_not_expired", f"select notice_id, due_date from {_FEED} where due_date is null or due_date >= timestamp '{AS_OF}'")
def feed_not_expired(t):
    return op.not_expired(_feed(t), AS_OF).select("notice_id", "due_date")


@query("feed_text_search", f"""select notice_id from {_FEED} where contains(lower(concat_ws(' ', title, coalesce(department, state, '—'),
 coalesce(location, '—'), coalesce(description, ''), array_to_string(tags, ' '))), 'the')""")
def feed_text_search(t):
    return op.search(_feed(t), " The ").select("notice_id")


@query("feed_by_location", f"""select notice_id from {_FEED} where lower(coalesce(location, '—')) = 'sacramento'
 or list_contains(list_transform(tags, lambda x: lower(x)), 'sacramento')""")
def feed_by_location(t):
    return op.by_tag(_feed(t), "SACRAMENTO", location=True).select("notice_id")


@query("feed_by_topic", f"select notice_id from {_FEED} where list_contains(list_transform(tags, lambda x: lower(x)), 'health services')")
def feed_by_topic(t):
    return op.by_tag(_feed(t), "health services").select("notice_id")


@query("feed_by_due_range", f"select notice_id from {_FEED} where due_date is null or due_date between timestamp '1998-06-01' and timestamp '1998-12-31'")
def feed_by_due_range(t):
    return op.by_due(_feed(t), "1998-06-01", "1998-12-31").select("notice_id")


@query("feed_by_price", f"select notice_id from (select notice_id, {_VALUE} as v from {_PARSED} where status = 'active' and is_relevant) where v is null or v between 400000 and 1500000")
def feed_by_price(t):
    return op.by_price(_feed(t), 400000, 1500000).select("notice_id")


@query("feed_by_price_numeric", f"select notice_id from {_FEED} where coalesce(amount_max, amount_min) >= 400000 and coalesce(amount_min, amount_max) <= 1500000")
def feed_by_price_numeric(t):
    return op.by_price(_feed(t), 400000, 1500000, numeric=True).select("notice_id")


@query("feed_by_metadata", "select notice_id from {notices} where event_type = 'Solicitation' and list_contains(naics_codes, '541512')")
def feed_by_metadata(t):
    return op.by_metadata(op.by_metadata(t.notices, "event_type", "Solicitation"), "naics_codes", "541512").select("notice_id")


@query("feed_sorted_by_score", f"""select row_number() over (order by coalesce(score, 0) desc, {_DUE}, contractor_id) as position, notice_id, contractor_id
 from {_FEED} left join {_LATEST} using (notice_id)""")
def feed_sorted_by_score(t):
    scored = op.view_model(_feed(t), t.scores).select("notice_id", "contractor_id", "score", "due_date")
    return rank_rows(scored, [], [F.col("score").desc(), *op.feed_order(), F.col("contractor_id")], [(F.col("score"), False), *op.feed_buckets()], "position") \
        .select("position", "notice_id", "contractor_id")


@query("feed_sorted_by_due", f"select row_number() over (order by {_DUE}) as position, notice_id from {_FEED}")
def feed_sorted_by_due(t):
    return rank_rows(_feed(t).select("notice_id", "due_date"), [], op.feed_order(), op.feed_buckets(), "position") \
        .select("position", "notice_id")


@query("saved_feed", "select s.contractor_id, n.notice_id, n.title from " + _FEED + f""" n join {{saved}} s using (notice_id)
 where n.due_date is null or n.due_date >= timestamp '{AS_OF}'""")
def saved_feed(t):
    return op.saved_feed(op.not_expired(_feed(t), AS_OF), t.saved).select("contractor_id", "notice_id", "title")


@query("history_feed", """select contractor_id, v.notice_id, viewed_at, cast(view_rank as int) as view_rank from (
  select *, row_number() over (partition by contractor_id order by viewed_at desc, notice_id) as view_rank
  from (select contractor_id, notice_id, max(viewed_at) as viewed_at from {views} group by 1, 2) qualify view_rank <= 50) v
 join """ + _FEED + " using (notice_id)")
def history_feed(t):
    return op.history_feed(_feed(t), t.views).select("contractor_id", "notice_id", "viewed_at", "view_rank")


def _values(tags, kind):
    return ", ".join(f"('{tag}', '{kind}', {i})" for i, tag in enumerate(tags))


@query("feed_facets", f"""with tax(value, kind, pos) as (values {_values(INDUSTRY_TAGS, 'industry')}, {_values(TOPIC_TAGS, 'topic')}),
 f as (select * from {_FEED}), tg as (select distinct unnest(tags) as value from f)
 select kind, value, cast(pos as int) as pos from tg join tax using (value)
 union all select 'location', value, null from (select value from tg where value not in (select value from tax)
  union select trim(location) from f where trim(location) not in ('', '—'))""")
def feed_facets(t):
    return op.facets(_feed(t).select("tags", "location"))


@query("feed_page_three", f"select notice_id, due_date from {_FEED} order by {_DUE} limit 20 offset 40")
def feed_page_three(t):
    return op.page(_feed(t).select("notice_id", "due_date"), op.feed_order(), 3)


@query("feed_page_count", f"select cast(greatest(1, ceil(count(*) / 20)) as bigint) as pages from {_FEED}")
def feed_page_count(t):
    return op.page_count(_feed(t))


@query("page_of_each_notice", f"select notice_id, cast(floor((row_number() over (order by {_DUE}) - 1) / 20) + 1 as bigint) as page from {_FEED}")
def page_of_each_notice(t):
    return op.page_of_each(_feed(t).select("notice_id", "due_date")).select("notice_id", "page")


@query("deadline_buckets", f"""select bucket, count(*) as n, min(days) as min_days from (select case when days is null then 'none' when days <= 0 then 'expired'
 when days <= 3 then 'red' when days <= 7 then 'yellow' else 'normal' end as bucket, days from
 (select cast(datediff('day', date '{AS_OF}', cast(due_date as date)) + 1 as int) as days from {_FEED})) group by 1""")
def deadline_buckets(t):
    return op.deadline_bucket(_feed(t), AS_OF).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("days_left").alias("min_days"))


_SAVED = "(select s.*, n.title, n.due_date from {saved} s join {notices} n using (notice_id))"


def _saved_list(t):
    return t.saved.join(t.notices.select("notice_id", "title", "due_date"), "notice_id")


for _mode, _order in {
    "custom": "sort_position asc nulls last, saved_at, lower(title), notice_id",
    "due_asc": "cast(due_date as date) asc nulls last, lower(title), notice_id",
    "due_desc": "cast(due_date as date) desc nulls first, lower(title) desc, notice_id desc",
    "saved_asc": "saved_at, lower(title), notice_id",
    "saved_desc": "saved_at desc, lower(title), notice_id",
    "title_asc": "lower(title), notice_id",
    "title_desc": "lower(title) desc, notice_id desc",
}.items():
    @query(f"saved_list_{_mode}", f"select contractor_id, notice_id, row_number() over (partition by contractor_id order by {_order}) as position from {_SAVED}")
    def saved_list(t, mode=_mode):
        return op.order_saved(_saved_list(t), mode).select("contractor_id", "notice_id", "position")


@query("saved_position_backfill", """select contractor_id, notice_id, coalesce(sort_position,
 cast(row_number() over (partition by contractor_id order by saved_at, notice_id) - 1 as int)) as sort_position from {saved}""")
def saved_position_backfill(t):
    return op.backfill_positions(t.saved).select("contractor_id", "notice_id", "sort_position")


@query("saved_next_position", """select c.contractor_id, coalesce(max(coalesce(s.sort_position, -1)) filter (s.notice_id is not null) + 1, 0) as next_position
 from {contractors} c left join {saved} s using (contractor_id) group by 1""")
def saved_next_position(t):
    return op.next_position(t.saved, t.contractors)


@query("saved_apply_order", """select contractor_id, notice_id, row_number() over (partition by contractor_id order by notice_id desc) - 1 as sort_position
 from {saved}""")
def saved_apply_order(t):
    dragged = rank_rows(t.saved.select("contractor_id", "notice_id"), ["contractor_id"], [F.col("notice_id").desc()],
                        [(F.floor(F.col("notice_id") / 64), False)], "rank")
    placed = dragged.select("contractor_id", "notice_id", (F.col("rank") - 1).alias("position"))
    return op.apply_order(t.saved, placed).select("contractor_id", "notice_id", "sort_position")


@query("bid_status_counts", "select contractor_id, coalesce(bid_status, 'reviewing') as bid_status, count(*) as n from {saved} group by 1, 2")
def bid_status_counts(t):
    return op.bid_status_counts(t.saved)


@query("bid_status_filter", "select contractor_id, notice_id from {saved} where coalesce(bid_status, 'reviewing') = 'reviewing'")
def bid_status_filter(t):
    return op.with_bid_status(t.saved, "reviewing").select("contractor_id", "notice_id")


@query("url_slot_list", """select notice_id, array_to_string(list_filter([case when notice_id % 3 = 0 then 'http://a/' || notice_id else '' end,
 case when notice_id % 2 = 0 then 'http://b/' || notice_id end, '  ', 'http://c/' || notice_id], lambda x: trim(x) <> ''), ' ') as urls from {notices}""")
def url_slot_list(t):
    ident = F.col("notice_id").cast("string")
    slots = t.notices.select(
        "notice_id",
        F.when(F.col("notice_id") % 3 == 0, F.concat(F.lit(" http://a/"), ident)).otherwise("").alias("pdf_url_1"),
        F.when(F.col("notice_id") % 2 == 0, F.concat(F.lit("http://b/"), ident)).alias("pdf_url_2"),
        F.lit("  ").alias("pdf_url_3"), F.concat(F.lit("http://c/"), ident).alias("pdf_url_4"))
    return slots.select("notice_id", F.array_join(op.url_list([f"pdf_url_{i}" for i in range(1, 5)]), " ").alias("urls"))


@query("unscored_notices", f"select notice_id from {_FEED} f where not exists (select 1 from {{scores}} s where s.notice_id = f.notice_id)")
def unscored_notices(t):
    return op.unscored(_feed(t), t.scores).select("notice_id")


@query("unscored_counts", f"""select c.contractor_id, (select count(*) from {_FEED}) - count(distinct s.notice_id) as unscored
 from {{contractors}} c left join (select contractor_id, notice_id from {{scores}} where notice_id in (select notice_id from {_FEED})) s using (contractor_id) group by 1""")
def unscored_counts(t):
    return op.unscored_counts(t.contractors, _feed(t), t.scores)


@query("factor_map", """select contractor_id, notice_id, score as total, 'reason ' || score_id as reason from (select * from {scores} qualify row_number() over (partition by contractor_id, notice_id order by computed_at desc, score_id desc) = 1)
 where model_version = 'compat-v2'""")
def factor_map(t):
    """Scores of the older model have no breakdown."""
    kept = F.when(F.col("model_version") == "compat-v2", F.struct(F.col("score").alias("total"), F.struct(F.concat(F.lit("reason "), F.col("score_id").cast("string")).alias("reason")).alias("timing")))
    return op.factor_map(t.scores.withColumn("factors", kept)).select("contractor_id", "notice_id", "factors.total", "factors.timing.reason")


@query("owner_scoped_saved", "select contractor_id, notice_id from {saved} where contractor_id in (select contractor_id from {contractors} where user_id = 'user7')")
def owner_scoped_saved(t):
    return op.owned(t.saved, t.contractors, "user7").select("contractor_id", "notice_id")


@query("summary_work_queue", f"""select notice_id from {_FEED} f where notice_id not in (select notice_id from {{summaries}}
 where summary_type = 'general' and prompt_version = 'detailed-v4') order by {_DUE} limit 500""")
def summary_work_queue(t):
    return op.work_queue(_feed(t), op.current_summaries(t.summaries, "general", "detailed-v4"), 500).select("notice_id")


_CANDIDATES = f"""(with f as (select notice_id, row_number() over (order by {_DUE}) as r from {_FEED}),
 c as (select contractor_id from {{contractors}})
 select contractor_id, notice_id, r from c, f where (contractor_id, notice_id) not in (select (contractor_id, notice_id) from {{scores}})
 and r <= {{cap}} + (select coalesce(max(n), 0) from (select count(*) as n from {{scores}} group by contractor_id)) qualify row_number() over (partition by contractor_id order by r) <= {{cap}})"""


@query("candidate_pairs", "select contractor_id, notice_id from " + _CANDIDATES.replace("{cap}", "100"))
def candidate_pairs(t):
    ready = op.has_signal(t.contractors, t.past_projects)
    return op.candidate_pairs(ready, _feed(t), t.scores).select("contractor_id", "notice_id")


@query("open_feed_page", f"""select contractor_id, notice_id, score, cast(position as int) as position from (select *, row_number() over (partition by contractor_id
  order by score desc, {_DUE}) as position from (
  select contractor_id, notice_id, score from {_LATEST} where notice_id in (select notice_id from {_FEED} where due_date is null or due_date >= timestamp '{AS_OF}')
  union all select contractor_id, notice_id, 0 from {_CANDIDATES.replace("{cap}", "20").replace("and is_relevant)", "and is_relevant and (due_date is null or due_date >= timestamp '" + AS_OF + "'))")})
  join (select notice_id, due_date from {{notices}}) using (notice_id)) where position <= 20""")
def open_feed_page(t):
    return op.scored_feed_page(t.contractors, op.not_expired(_feed(t), AS_OF), t.scores) \
        .select("contractor_id", "notice_id", "score", "position")
