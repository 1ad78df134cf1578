"""Notice feed: filters, sorts, facets, paging and saved lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderspark.fixed import INDUSTRY_TAGS, TOPIC_TAGS
from tenderspark.functions.common import blank_to_null, drop_blank, let, literals, round_half_up, strip
from tenderspark.operators.ranking import first_by, rank_rows, top_per_key
from tenderspark.session import stage

# Width of the notice-key ranges a crowded day is split into when the feed is ranked.
ID_BUCKET = 1 << 20


def feed_order() -> list[Column]:
    return [F.col("due_date").asc_nulls_last(), F.col("notice_id")]


def feed_buckets() -> list[tuple[Column, bool]]:
    return [(F.to_date("due_date"), True), (F.floor(F.col("notice_id") / ID_BUCKET), True)]


def base_feed(notices: DataFrame, include_amended: bool = False) -> DataFrame:
    """Open and relevant notices."""
    status = F.col("status").isin("active", "amended") if include_amended else F.col("status") == "active"
    return notices.filter(status & F.col("is_relevant"))


def order_by_due(df: DataFrame) -> DataFrame:
    return df.orderBy(*feed_order())


def order_by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").desc(), *feed_order())


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest cached score per (contractor, notice)."""
    return first_by(scores, ["contractor_id", "notice_id"], [F.col("computed_at"), F.col("score_id")], latest=True)


def current_summaries(summaries: DataFrame, kind: str, version: str) -> DataFrame:
    """Newest summary per notice of one kind and version."""
    wanted = summaries.filter((F.col("summary_type") == kind) & (F.col("prompt_version") == version))
    return first_by(wanted, ["notice_id"], [F.col("generated_at"), F.col("summary_id")], latest=True)


def format_amount(lo: Column, hi: Column) -> Column:
    """Short money text: `—`, `$1.2M`, `$850K`, `$900`, or a range."""
    def one(n: Column) -> Column:
        tenths = round_half_up(n / 100000).cast("bigint")
        whole = F.floor(tenths / 10).cast("string")
        millions = F.when(n % 1000000 == 0, F.floor(n / 1000000).cast("string")) \
            .otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))
        return (F.when(n >= 1000000, F.concat(F.lit("$"), millions, F.lit("M")))
                .when(n >= 1000, F.concat(F.lit("$"), round_half_up(n / 1000).cast("string"), F.lit("K")))
                .when(n >= 999.5, F.lit("$1,000"))
                .otherwise(F.concat(F.lit("$"), round_half_up(n).cast("string"))))

    return (F.when(lo.isNull() & hi.isNull(), F.lit("—"))
            .when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(one(lo), F.lit(" – "), one(hi)))
            .otherwise(one(F.coalesce(lo, hi))))


def parse_amount(text: Column) -> Column:
    """Number behind a money text; null where a suffixed text is no number (a range)."""
    numeric = r"^[+-]?(\d+\.?\d*|\.\d+)$"

    def number(raw: Column) -> Column:
        return let(strip(raw), lambda s: F.when(s == "", F.lit(0.0)).when(s.rlike(numeric), s.cast("double")))

    def value(norm: Column) -> Column:
        stem = F.substring(norm, F.lit(1), F.length(norm) - 1)
        return (F.when(norm.endswith("M"), number(stem) * 1000000)
                .when(norm.endswith("K"), number(stem) * 1000)
                .otherwise(F.coalesce(number(norm), F.lit(0.0))))

    return let(F.upper(strip(F.regexp_replace(text, "[$,]", ""))), value)


def url_list(row_urls: list[str]) -> Column:
    """Non-blank URL slots in slot order."""
    return drop_blank(F.transform(F.array(*row_urls), strip))


def view_model(notices: DataFrame, scores: DataFrame) -> DataFrame:
    """Dashboard rows: one per notice and scoring contractor (none: score 0)."""
    latest = latest_scores(scores).select("contractor_id", "notice_id", "score")
    joined = notices.join(latest, "notice_id", "left")
    return joined.select(
        "notice_id", "contractor_id",
        F.coalesce(blank_to_null("name"), F.col("title")).alias("name"), "title",
        F.coalesce("department", "state", F.lit("—")).alias("agency"),
        F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("—")).alias("due"), "due_date",
        F.coalesce("score", F.lit(0.0)).alias("score"), "tags",
        F.coalesce("location", F.lit("—")).alias("location"),
        format_amount(F.col("amount_min"), F.col("amount_max")).alias("contract"),
        F.coalesce("description", F.lit("")).alias("description"),
        strip(F.coalesce("statement_of_work", F.lit(""))).alias("statement_of_work"))


def not_expired(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("due_date").isNull() | (F.col("due_date") >= F.lit(as_of).cast("timestamp")))


def search(df: DataFrame, text: str) -> DataFrame:
    """Lower-case substring search over title, agency, location, description and tags."""
    needle = text.strip().lower()
    if not needle:
        return df
    hay = F.concat_ws(" ", "title", F.coalesce("department", "state", F.lit("—")), F.coalesce("location", F.lit("—")),
                      F.coalesce("description", F.lit("")), F.array_join("tags", " "))
    return df.filter(F.contains(F.lower(hay), F.lit(needle)))


def by_tag(df: DataFrame, value: str, location: bool = False) -> DataFrame:
    needle = F.lit(value.lower())
    hit = F.exists("tags", lambda t: F.lower(t) == needle)
    if location:
        hit = hit | (F.lower(F.coalesce("location", F.lit("—"))) == needle)
    return df.filter(hit)


def by_due(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if lo:
        keep = keep & (F.col("due_date") >= F.lit(lo).cast("timestamp"))
    if hi:
        keep = keep & (F.col("due_date") <= F.lit(hi).cast("timestamp"))
    return df.filter(F.col("due_date").isNull() | keep)


def by_price(df: DataFrame, lo: float | None = None, hi: float | None = None, numeric: bool = False) -> DataFrame:
    """Price bounds on the shown text, where a range passes; `numeric` tests the raw amounts."""
    if numeric:
        low, high = F.coalesce("amount_min", "amount_max"), F.coalesce("amount_max", "amount_min")
    else:
        low = high = parse_amount(format_amount(F.col("amount_min"), F.col("amount_max")))
    def inside(bounds: Column) -> Column:
        keep = F.lit(True)
        if lo is not None:
            keep = keep & F.coalesce(bounds.high >= lo, F.lit(not numeric))
        if hi is not None:
            keep = keep & F.coalesce(bounds.low <= hi, F.lit(not numeric))
        return keep

    return df.filter(let(F.struct(low.alias("low"), high.alias("high")), inside))


def by_metadata(df: DataFrame, path: str, value: str) -> DataFrame:
    """Containment in a nested field: equality, or membership where it is an array."""
    if dict(df.dtypes).get(path, "").startswith("array"):
        return df.filter(F.array_contains(path, value))
    return df.filter(F.col(path) == value)


def saved_feed(feed: DataFrame, saved: DataFrame) -> DataFrame:
    return feed.join(saved.select("contractor_id", "notice_id"), "notice_id") if "contractor_id" not in feed.columns \
        else feed.join(saved, ["contractor_id", "notice_id"], "left_semi")


def latest_views(views: DataFrame) -> DataFrame:
    """One row per (contractor, notice) with the newest view."""
    return views.groupBy("contractor_id", "notice_id").agg(F.max("viewed_at").alias("viewed_at"))


def history_feed(notices: DataFrame, views: DataFrame, n: int = 50) -> DataFrame:
    """The `n` newest views per contractor, then those that are loaded notices."""
    newest = top_per_key(latest_views(views), ["contractor_id"],
                         [F.col("viewed_at").desc(), F.col("notice_id")], n, rank="view_rank")
    return newest.join(notices, "notice_id")


def facets(feed: DataFrame) -> DataFrame:
    """Filter values in use: curated industries and topics, other tags and places as locations."""
    tags = feed.select(F.explode("tags").alias("value")).distinct()
    industry = F.array_position(literals(INDUSTRY_TAGS), F.col("value"))
    topic = F.array_position(literals(TOPIC_TAGS), F.col("value"))
    kind = F.when(industry > 0, "industry").when(topic > 0, "topic").otherwise("location")
    place = F.greatest(industry, topic)
    grouped = tags.select(kind.alias("kind"), "value", F.when(place > 0, (place - 1).cast("int")).alias("pos"))
    places = feed.select(F.lit("location").alias("kind"), strip("location").alias("value"), F.lit(None).cast("int").alias("pos")) \
        .filter((F.col("value") != "") & (F.col("value") != "—"))
    return grouped.union(places).distinct()


def page(df: DataFrame, order: list[Column], n: int, size: int = 20) -> DataFrame:
    """Page `n` (1-based) under a total `order`."""
    return df.orderBy(*order).offset((n - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("bigint").alias("pages"))


def page_of_each(df: DataFrame, size: int = 20) -> DataFrame:
    """The page on which each notice of the due-ordered feed stands."""
    ranked = rank_rows(df, [], feed_order(), feed_buckets(), "position")
    return ranked.withColumn("page", F.floor((F.col("position") - 1) / size) + 1)


def deadline_bucket(df: DataFrame, as_of: str) -> DataFrame:
    days = F.datediff(F.col("due_date"), F.lit(as_of).cast("date")) + 1
    return df.withColumn("days_left", days).withColumn(
        "bucket", F.when(days.isNull(), "none").when(days <= 0, "expired").when(days <= 3, "red")
        .when(days <= 7, "yellow").otherwise("normal"))


def saved_order(mode: str) -> list[Column]:
    """Sort keys of the saved list; ties fall back to the title, then the notice key."""
    title, ident = F.lower("title"), F.col("notice_id")
    return {
        "due_asc": [F.to_date("due_date").asc_nulls_last(), title.asc(), ident.asc()],
        "due_desc": [F.to_date("due_date").desc_nulls_first(), title.desc(), ident.desc()],
        "saved_asc": [F.col("saved_at").asc(), title.asc(), ident.asc()],
        "saved_desc": [F.col("saved_at").desc(), title.asc(), ident.asc()],
        "title_asc": [title.asc(), ident.asc()],
        "title_desc": [title.desc(), ident.desc()],
        "custom": [F.col("sort_position").asc_nulls_last(), F.col("saved_at").asc(), title.asc(), ident.asc()],
    }[mode]


def _saved_bucket(mode: str) -> tuple[Column, bool]:
    return {"due_asc": (F.to_date("due_date"), True),
            "saved_asc": (F.date_trunc("hour", "saved_at"), True),
            "saved_desc": (F.date_trunc("hour", "saved_at"), False),
            "title_asc": (F.substring(F.lower("title"), 1, 4), True),
            "title_desc": (F.substring(F.lower("title"), 1, 4), False),
            "custom": (F.col("sort_position"), True)}.get(mode, (F.coalesce(F.to_date("due_date"), F.lit("9999-12-31").cast("date")), False))


def order_saved(saved_with_notice: DataFrame, mode: str) -> DataFrame:
    """Saved list of every contractor in the asked order, with its 1-based position."""
    return rank_rows(saved_with_notice, ["contractor_id"], saved_order(mode), [_saved_bucket(mode)], "position")


def backfill_positions(saved: DataFrame) -> DataFrame:
    """Fill missing positions with the 0-based rank by save time and notice."""
    ranked = rank_rows(saved, ["contractor_id"], [F.col("saved_at"), F.col("notice_id")],
                       [(F.date_trunc("hour", "saved_at"), True)], "_rank")
    return ranked.withColumn("sort_position", F.coalesce(F.col("sort_position"), (F.col("_rank") - 1).cast("int"))).drop("_rank")


def next_position(saved: DataFrame, contractors: DataFrame) -> DataFrame:
    """Position of the next save: one past the largest, 0 for an empty list."""
    top = saved.groupBy("contractor_id").agg(F.max(F.coalesce("sort_position", F.lit(-1))).alias("_top"))
    return contractors.select("contractor_id").join(top, "contractor_id", "left") \
        .select("contractor_id", F.coalesce(F.col("_top") + 1, F.lit(0)).alias("next_position"))


def apply_order(saved: DataFrame, placed: DataFrame) -> DataFrame:
    """Positions from given rows (contractor_id, notice_id, position); unlisted rows drop out."""
    return saved.drop("sort_position").join(placed, ["contractor_id", "notice_id"]) \
        .withColumnRenamed("position", "sort_position")


def bid_status_counts(saved: DataFrame) -> DataFrame:
    return saved.groupBy("contractor_id", F.coalesce("bid_status", F.lit("reviewing")).alias("bid_status")) \
        .agg(F.count(F.lit(1)).alias("n"))


def with_bid_status(saved: DataFrame, status: str) -> DataFrame:
    return saved.filter(F.coalesce("bid_status", F.lit("reviewing")) == status)


def candidate_pairs(contractors: DataFrame, feed: DataFrame, scores: DataFrame, cap: int = 100, kept: DataFrame | None = None) -> DataFrame:
    """The first `cap` unscored feed notices of each contractor, in lots of one contractor.

    A contractor with s scored notices finds them among the first cap + s feed
    ranks, so only the head of the feed up to the greatest cap + s is used; it is
    staged, so that Spark knows how short it is.  Which ranks are left is worked out
    in the contractor's row from the ranks already scored: no contractor x notice
    product, and the pairs themselves are not shuffled.  With `kept`
    (contractor_id, notice_id: distinct pairs of any contractor, without nulls) these
    are added, every pair comes once, and there is no feed_rank.
    """
    spark = feed.sparkSession
    scored = scores.select("contractor_id", "notice_id").distinct()
    n_scored = scored.groupBy("contractor_id").agg(F.count(F.lit(1)).alias("_s"))
    reach = cap + (n_scored.agg(F.max("_s")).first()[0] or 0)
    ranked = rank_rows(feed.select("notice_id", "due_date"), [], feed_order(), feed_buckets(), "feed_rank") \
        .withColumn("feed_rank", F.col("feed_rank").cast("int")).select("feed_rank", "notice_id")
    head = ranked.filter(F.col("feed_rank") <= reach)
    first = stage(head.withColumn("_least", F.min("feed_rank").over(Window.partitionBy("notice_id"))), "feed-head")
    taken = scored.join(first, "notice_id").groupBy("contractor_id").agg(F.collect_set("feed_rank").alias("_taken"))
    open_ranks = F.slice(F.array_except(F.sequence(F.lit(1), (F.lit(cap) + F.coalesce("_s", F.lit(0))).cast("int")), F.coalesce("_taken", F.array().cast("array<int>"))), 1, cap)
    # A contractor that is given more than once has its ranks as often.
    open_ranks = F.when(F.col("_copies") == 1, open_ranks).otherwise(F.slice(F.flatten(F.transform(open_ranks, lambda r: F.array_repeat(r, F.col("_copies")))), 1, cap))
    # Of a notice that the feed has more than once the least rank stands for it.
    given = contractors.select("contractor_id", F.lit(1).alias("_copies"))
    if kept is not None:
        least = first.filter("feed_rank = _least").select("notice_id", "feed_rank")
        given = given.withColumn("_one", F.lit(None).cast(T.StructType([least.schema["feed_rank"], kept.schema["notice_id"]]))) \
            .unionByName(kept.join(least, "notice_id", "left").select("contractor_id", F.lit(0).alias("_copies"), F.struct("feed_rank", "notice_id").alias("_one")))
    # A set number of partitions, as few small rows become many here.
    each = given.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "contractor_id").groupBy("contractor_id") \
        .agg(F.sum("_copies").cast("int").alias("_copies"), *([] if kept is None else [F.collect_list("_one").alias("_kept")]))
    wanted = each.join(n_scored, "contractor_id", "left").join(taken, "contractor_id", "left").withColumn("_open", open_ranks)
    if kept is None:
        fresh = wanted.select("contractor_id", F.explode("_open").alias("feed_rank")).join(first, "feed_rank").select("contractor_id", "notice_id", "feed_rank")
        return top_per_key(fresh, ["contractor_id"], [F.col("feed_rank")], cap)
    more = F.filter("_kept", lambda k: ~F.coalesce(F.array_contains(F.col("_open"), k["feed_rank"]), F.lit(False)))
    open_ones = F.transform(F.array_distinct("_open"), lambda r: F.struct(r.alias("feed_rank"), F.lit(None).cast(kept.schema["notice_id"].dataType).alias("notice_id")))
    shown = wanted.select("contractor_id", F.inline(F.concat(open_ones, more)))
    return shown.join(first.withColumnRenamed("notice_id", "_notice"), "feed_rank", "left").filter("notice_id is not null or feed_rank = _least") \
        .select("contractor_id", F.coalesce("notice_id", "_notice").alias("notice_id"))


def has_signal(contractors: DataFrame, past: DataFrame) -> DataFrame:
    """Contractors with industries, goals or any past work to score against."""
    worked = past.select("contractor_id").distinct().withColumn("_worked", F.lit(True))
    some = lambda c: F.exists(c, lambda x: strip(x) != "")
    return contractors.join(worked, "contractor_id", "left").filter(
        some("industries") | some("sub_industries") | (strip(F.coalesce("goals", F.lit(""))) != "")
        | F.coalesce("_worked", F.lit(False))).drop("_worked")


def scored_feed_page(contractors: DataFrame, feed: DataFrame, scores: DataFrame, size: int = 20) -> DataFrame:
    """First page of every contractor's feed, best score first."""
    latest = latest_scores(scores).select("contractor_id", "notice_id", "score")
    scored = latest.join(feed.select("notice_id"), "notice_id").select("contractor_id", "notice_id", "score")
    rest = candidate_pairs(contractors, feed, scores, size).select("contractor_id", "notice_id", F.lit(0.0).alias("score"))
    due = feed.select("notice_id", "due_date")
    return top_per_key(scored.union(rest).join(due, "notice_id"), ["contractor_id"],
                       [F.col("score").desc(), *feed_order()], size, rank="position")


def unscored(feed: DataFrame, scores: DataFrame) -> DataFrame:
    """Feed notices nobody in `scores` has a score for (pass one contractor's scores)."""
    return feed.join(scores.select("notice_id"), "notice_id", "left_anti")


def factor_map(scores: DataFrame) -> DataFrame:
    """(contractor_id, notice_id, factors): the breakdown of each newest cached score that has one."""
    return latest_scores(scores).filter(F.col("factors").isNotNull()).select("contractor_id", "notice_id", "factors")


def unscored_counts(contractors: DataFrame, feed: DataFrame, scores: DataFrame) -> DataFrame:
    """Number of unscored feed notices per contractor."""
    size = feed.agg(F.count(F.lit(1)).alias("_n")).scalar()
    scored = scores.select("contractor_id", "notice_id").distinct().join(feed.select("notice_id"), "notice_id", "left_semi") \
        .groupBy("contractor_id").agg(F.count(F.lit(1)).alias("_s"))
    return contractors.select("contractor_id").join(scored, "contractor_id", "left") \
        .select("contractor_id", (size - F.coalesce("_s", F.lit(0))).alias("unscored"))


def owned(df: DataFrame, contractors: DataFrame, user_id: str | None = None) -> DataFrame:
    """Rows of the contractors one user owns (or any user owns)."""
    mine = contractors if user_id is None else contractors.filter(F.col("user_id") == user_id)
    return df.join(mine.select("contractor_id"), "contractor_id", "left_semi")


def work_queue(feed: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """First `limit` feed notices without finished work, by due date."""
    return feed.join(done.select("notice_id"), "notice_id", "left_anti").orderBy(*feed_order()).limit(limit)
