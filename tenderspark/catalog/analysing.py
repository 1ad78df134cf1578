"""Event analytics and the profile view over the whole tables."""

from pyspark.sql import functions as F

from tenderspark.catalog.registry import query
from tenderspark.operators import analytics as an
from tenderspark.operators.profiles import profile_view

LAST_DAY = "2024-01-31"

# The event types of the test data stand for the product's steps.
_SPINE = "(select cast(d as date) as day, event_type from generate_series(timestamp '2024-01-02', timestamp '2024-01-31', interval 1 day) g(d), (values {0}) v(event_type))"


def _daily(types):
    values = ", ".join(f"('{x}')" for x in types)
    return f"""select day, event_type, coalesce(n, 0) as n from {_SPINE.format(values)} left join (select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2) using (day, event_type)"""


@query("daily_sign_ups", _daily(["signup"]))
def daily_sign_ups(t):
    return an.daily_counts(t.events, ["signup"], LAST_DAY)


@query("daily_core_actions", _daily(["click", "view", "purchase", "error"]))
def daily_core_actions(t):
    return an.daily_counts(t.events, ["click", "view", "purchase", "error"], LAST_DAY)


def _funnel(steps):
    sql = f"with r0 as (select user_id, min(ts) as t from events where event_type = '{steps[0]}' group by 1)"
    for i, s in enumerate(steps[1:], 1):
        sql += f", r{i} as (select e.user_id, min(e.ts) as t from events e join r{i - 1} r on e.user_id = r.user_id and e.ts >= r.t where event_type = '{s}' group by 1)"
    return sql + " " + " union all ".join(f"select {i} as step, '{s}' as event_type, (select count(*) from r{i}) as users, (select count(*) from r{i}) / (select count(*) from r0) as rate" for i, s in enumerate(steps))


@query("engagement_funnel", _funnel(["click", "view", "purchase"]))
def engagement_funnel(t):
    return an.funnel(t.events, ["click", "view", "purchase"])


@query("onboarding_funnel", _funnel(["signup", "purchase"]))
def onboarding_funnel(t):
    return an.funnel(t.events, ["signup", "purchase"])


@query("filter_usage", "select cast(ts as date) as day, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error from events where event_type in ('click', 'error') group by 1")
def filter_usage(t):
    return an.daily_pivot(t.events, ["click", "error"])


_VARIANT = "case when cast(props::json->>'$.k' as int) % 2 = 0 then 'A' else 'B' end"


@query("variant_comparison", f"select variant, event_type, n, users, n / sum(n) over (partition by variant) as share from (select {_VARIANT} as variant, event_type, count(*) as n, count(distinct user_id) as users from events group by 1, 2)")
def variant_comparison(t):
    key = F.get_json_object("props", "$.k").cast("int")
    return an.variant_compare(t.events, F.when(key % 2 == 0, "A").otherwise("B"))


@query("variant_switches", f"select {_VARIANT} as from_variant, case when value > 50 then 'A' else 'B' end as to_variant, count(*) as n from events group by 1, 2")
def variant_switches(t):
    key = F.get_json_object("props", "$.k").cast("int")
    return an.variant_switches(t.events, F.when(key % 2 == 0, "A").otherwise("B"), F.when(F.col("value") > 50, "A").otherwise("B"))


@query("profile_view", """select c.contractor_id, array_to_string(c.industries, ', ') as industries, array_to_string(c.preferred_locations, ', ') as preferred_locations, coalesce(c.goals, '') as goals,
 coalesce(string_agg(trim(case when project_name <> 'Experience profile' then '**' || project_name || '**' || chr(10) else '' end || coalesce(description, ''), chr(10) || ' '), chr(10) || chr(10) order by project_id)
   filter (coalesce(trim(client), '') = '' and trim(case when project_name <> 'Experience profile' then '**' || project_name || '**' || chr(10) else '' end || coalesce(description, ''), chr(10) || ' ') <> ''), '') as past_experience,
 coalesce(any_value(cl.names), '') as past_clients, coalesce(cast(c.preferred_response_window_days as varchar), '') as window_days
 from {contractors} c left join {past_projects} p using (contractor_id) left join (select contractor_id, string_agg(client, ', ' order by project_id) as names from (select contractor_id, project_id, trim(client) as client from {past_projects} where trim(client) <> ''
  qualify row_number() over (partition by contractor_id, lower(trim(client)) order by project_id) = 1) group by 1) cl using (contractor_id) group by all""")
def profile_view_query(t):
    return profile_view(t.contractors, t.past_projects).select("contractor_id", "industries", "preferred_locations", "goals", "past_experience", "past_clients", "window_days")
