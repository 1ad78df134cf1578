"""Keeping the notice tables: merges, change records, caches and quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.fixed import BID_STATUSES
from tenderspark.functions.common import blank_to_null, drop_blank, strip
from tenderspark.functions.normalize import safe_id
from tenderspark.operators.ranking import first_by, last_before, rank_rows, top_per_key
from tenderspark.sources.raw import metadata_text, processed_json

SLOTS = 10


def skip_existing(candidates: DataFrame, landed: DataFrame, ident: str, default: str = "notice") -> DataFrame:
    """Candidates whose safe id has not landed yet."""
    known = landed.select(safe_id(ident, default).alias("_known"))
    return candidates.join(known, safe_id(candidates[ident], default) == F.col("_known"), "left_anti")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First arrival per key."""
    return first_by(df, keys, order)


def to_notice_row(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Processed record -> table row: renamed fields, state, URL slots, empty arrays instead of null, metadata and the whole record as JSON."""
    state = F.when((F.col("location_level") == "state") | (F.col("location") == "California"), F.lit("California"))
    urls = F.filter(F.transform("documents", lambda d: d["url"]), lambda u: u.isNotNull() & (u != ""))
    empty = F.array().cast("array<string>")
    base = df.withColumn("_urls", urls)
    slots = [F.try_element_at("_urls", F.lit(i + 1)).alias(f"pdf_url_{i + 1}") for i in range(SLOTS)]
    return base.select(
        "source", "external_id", "title", "name", "statement_of_work",
        F.coalesce("deliverables", empty).alias("deliverables"), "description", "location", "location_level",
        state.alias("state"), F.col("dept").alias("department"), "due_date", F.col("published_date").alias("posted_date"),
        F.coalesce("tags", empty).alias("tags"), "is_relevant", "contact_name", "contact_email", "contact_phone",
        "content_hash", F.coalesce("status", F.lit("active")).alias("status"),
        metadata_text(df).alias("metadata"), processed_json(df).alias("raw_data"), *slots, *keep)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that carry every key field, not blank."""
    for k in keys:
        df = df.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return df


def merge_sparse(base: DataFrame, updates: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (),
                 order: Sequence[Column] = (), touch: tuple[str, Column] | None = None,
                 replace: Sequence[str] = ()) -> DataFrame:
    """Keyed upsert in which a null new value keeps the old one.

    Columns in `overwrite` take the new value of a matched row even when it is
    null; `replace` adds more such columns (e.g. URL slots of a shrunken list).
    Updates without a key are left out.  With `order` the last update per key
    counts.  `touch` = (column, value) is set on rows that were added or changed.
    """
    new = keyed(updates, keys)
    if order:
        new = first_by(new, keys, order, latest=True)
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    o = base.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias("_o"))
    both = o.join(n, list(keys), "full_outer")
    hard = {*overwrite, *replace}
    changed = F.lit(False)
    cols = []
    for c in base.columns:
        if c in keys or (touch and c == touch[0]):
            continue
        old = F.col("_o").getField(c)
        if c not in new.columns:
            cols.append(old.alias(c))
            continue
        fresh = F.col("_n").getField(c)
        value = F.when(F.col("_n").isNotNull(), fresh).otherwise(old) if c in hard else F.coalesce(fresh, old)
        changed = changed | ~value.eqNullSafe(old)
        cols.append(value.alias(c))
    if touch:
        cols.append(F.when(F.col("_n").isNotNull() & changed, touch[1]).otherwise(F.col("_o").getField(touch[0])).alias(touch[0]))
    return both.select(*keys, *cols).select(*base.columns)


def fold_updates(updates: DataFrame, keys: Sequence[str], order: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """The updates of each key as one: every field's last value that isn't null, of `overwrite` fields the last one as it is.

    Merged at once this gives what merging them one after the other in `order`
    (columns, greatest last; they don't stay) would.  An aggregate, so a key with
    many updates is folded before the shuffle.
    """
    at = F.struct(*order)
    last = [F.max_by(c, at if c in overwrite else F.when(F.col(c).isNotNull(), at)).alias(c) for c in updates.columns if c not in keys and c not in order]
    return keyed(updates, keys).groupBy(*keys).agg(*last).select(*[c for c in updates.columns if c not in order])


def amendments(base: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per known notice whose content hash differs, with its changed fields.

    ``changes`` maps a field to its old and new text.
    """
    o = base.select(*keys, F.struct(*fields, "content_hash").alias("_o"))
    n = keyed(updates, keys).select(*keys, F.struct(*fields, "content_hash").alias("_n"))
    pairs = o.join(n, list(keys)).filter(F.col("_o.content_hash") != F.col("_n.content_hash"))
    entries = [F.struct(F.lit(f).alias("key"), F.struct(F.col(f"_o.{f}").cast("string").alias("old"),
                                                         F.col(f"_n.{f}").cast("string").alias("new")).alias("value"))
               for f in fields]
    changed = F.filter(F.array(*entries), lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"]))
    return pairs.select(*keys, F.col("_o.content_hash").alias("old_hash"), F.col("_n.content_hash").alias("new_hash"),
                        F.map_from_entries(changed).alias("changes"))


def apply_amendments(merged: DataFrame, amended: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Mark amended notices; run after the merge of the same batch.  Notices without a change keep when they were last amended."""
    earlier = F.col("last_amended_at") if "last_amended_at" in merged.columns else F.lit(None).cast("timestamp")
    marks = amended.select(*keys, F.lit(True).alias("_hit"), F.col("new_hash").alias("_hash"))
    hit = F.coalesce("_hit", F.lit(False))
    return merged.join(marks, list(keys), "left") \
        .withColumn("status", F.when(hit, "amended").otherwise(F.col("status"))) \
        .withColumn("content_hash", F.when(hit, F.col("_hash")).otherwise(F.col("content_hash"))) \
        .withColumn("last_amended_at", F.when(hit, at).otherwise(earlier)).drop("_hit", "_hash")


def merge_amended(base: DataFrame, updates: DataFrame, keys: Sequence[str], overwrite: Sequence[str], at: Column) -> DataFrame:
    """`merge_sparse` and `apply_amendments` of the same updates, in one join.

    The updates are read once.  `updates` has one row a key; a key that stands in
    several rows of `base` is marked once for each of them that differs, as there.
    """
    hashes = base.groupBy(*keys).agg(F.collect_list("content_hash").alias("_hashes"))
    known = base.join(hashes, list(keys), "left").withColumn("_fresh", F.lit(None).cast("string"))
    merged = merge_sparse(known, updates.withColumn("_fresh", F.col("content_hash")), keys, overwrite)
    earlier = F.col("last_amended_at") if "last_amended_at" in base.columns else F.lit(None).cast("timestamp")
    marks = F.coalesce(F.size(F.filter("_hashes", lambda h: h != F.col("_fresh"))), F.lit(0))
    hit = F.col("_marks") > 0
    marked = merged.withColumn("_marks", marks).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("_marks", F.lit(1)))))
    return marked.withColumn("status", F.when(hit, "amended").otherwise(F.col("status"))) \
        .withColumn("content_hash", F.when(hit, F.col("_fresh")).otherwise(F.col("content_hash"))) \
        .withColumn("last_amended_at", F.when(hit, at).otherwise(earlier)).drop("_hashes", "_fresh", "_marks", "_copy")


def keep_newest(df: DataFrame, key: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    """The `n` newest rows per key."""
    return top_per_key(df, [key], [F.col(ts).desc(), F.col(tie).desc()], n)


def split_fresh(scores: DataFrame, contractors: DataFrame, force: bool = False) -> DataFrame:
    """Adds `fresh`: computed at or after the contractor's last change, and not forced."""
    joined = scores.join(contractors.select("contractor_id", "updated_at"), "contractor_id")
    return joined.withColumn("fresh", (F.col("computed_at") >= F.col("updated_at")) & F.lit(not force))


def purge_stale(summaries: DataFrame, kind: str, version: str) -> DataFrame:
    """Drop summaries of one kind with another version or none."""
    current = F.col("prompt_version").eqNullSafe(F.lit(version))
    return summaries.filter(~((F.col("summary_type") == kind) & ~current))


def quality_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, bad): number of rows breaking each rule.  A null outcome passes, as in a check constraint."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "bad")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold every rule, rows that break one)."""
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(True))
    return df.filter(ok), df.filter(~ok)


def split_list(c: str) -> Column:
    """Comma, semicolon or line separated text -> trimmed non-blank items."""
    return drop_blank(F.transform(F.split(F.col(c), r"[,;\n]+"), strip))


def number_or_null(c: str) -> Column:
    return F.when(strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(c).try_cast("double"))


def profile_to_contractor(df: DataFrame) -> DataFrame:
    """Profile form texts -> contractor columns."""
    return df.select(
        "contractor_id", split_list("industries").alias("industries"), split_list("sub_industries").alias("sub_industries"),
        F.nullif("goals", F.lit("")).alias("goals"), split_list("preferred_locations").alias("preferred_locations"),
        number_or_null("contract_min").alias("preferred_contract_min"), number_or_null("contract_max").alias("preferred_contract_max"),
        number_or_null("window_days").try_cast("int").alias("preferred_response_window_days"),
        split_list("naics_codes").alias("naics_codes"), split_list("exclusions").alias("exclusions"))


def replace_children(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """Replace the past projects of saved profiles (contractor_id, past_experience, past_clients).

    A profile leaves one narrative row and one row per distinct client, spelled as first given.
    """
    kept = projects.join(profiles.select("contractor_id"), "contractor_id", "left_anti") \
        .select("contractor_id", "project_name", "description", "client")
    narrative = profiles.select("contractor_id", F.lit("Experience profile").alias("project_name"),
                                blank_to_null("past_experience").alias("description"), F.lit(None).cast("string").alias("client")) \
        .filter(F.col("description").isNotNull())
    clients = profiles.select("contractor_id", F.posexplode(split_list("past_clients")).alias("_pos", "client"))
    distinct = first_by(clients.withColumn("_key", F.lower("client")), ["contractor_id", "_key"], [F.col("_pos")]) \
        .select("contractor_id", F.col("client").alias("project_name"), F.lit(None).cast("string").alias("description"), "client")
    return kept.unionByName(narrative).unionByName(distinct)


def cache_split(df: DataFrame, cache: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Adds `hit`: a stored result with the same non-empty hash and all `fields` filled."""
    stored = cache.select(*keys, F.col("content_hash").alias("_hash"), *[F.col(f).alias(f"cached_{f}") for f in fields])
    filled = F.lit(True)
    for f in fields:
        filled = filled & (F.coalesce(F.col(f"cached_{f}"), F.lit("")) != "")
    hit = (F.col("_hash") == F.col("content_hash")) & (F.col("content_hash") != "") & filled
    return df.join(stored, list(keys), "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_hash")


def merge_summaries(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (notice, kind, version)."""
    return merge_sparse(base, new, ["notice_id", "summary_type", "prompt_version"])


def merge_scores(base: DataFrame, new: DataFrame, keep: int = 100) -> DataFrame:
    """One row per (contractor, notice), then the newest `keep` per contractor."""
    merged = merge_sparse(base, new, ["contractor_id", "notice_id"])
    return keep_newest(merged, "contractor_id", "computed_at", "notice_id", keep)


PAIR = ["contractor_id", "notice_id"]


def saved_state(base: DataFrame) -> DataFrame:
    """A saved list as the state that changes are folded into: its rows, all `kept` so far."""
    return base.withColumn("kept", F.lit(True))


def fold_saved_changes(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One state row per saved (contractor, notice), with a log of save / unsave / note / status changes folded in.

    `state`: contractor_id, notice_id, saved_at, sort_position, notes, bid_status,
    kept.  `changes`: change_id, contractor_id, notice_id, kind, value, ts.  Returns
    (new state, rejected changes).  A note or status for a notice that is not saved
    at that moment is rejected.  Unsaving forgets the row; a new save starts with
    no note and `reviewing`.  Folding a log in parts, in the order of time, gives
    the state that folding it at once gives.
    """
    held = state.select(*PAIR, F.lit(True).alias("_held"))
    toggle = F.when(F.col("kind").isin("save", "unsave"), F.col("kind"))
    log = last_before(changes, PAIR, "ts", "change_id", toggle, "_state").join(held, PAIR, "left")
    saved_now = F.coalesce(F.col("_state") == "save", F.col("_held"), F.lit(False))
    edit = F.col("kind").isin("note", "status")
    valid_value = (F.col("kind") != "status") | F.col("value").isin(*BID_STATUSES)
    log = log.withColumn("_ok", ~edit | (saved_now & F.coalesce(valid_value, F.lit(False)))).withColumn("_saved_now", saved_now)
    moment = F.struct("ts", "change_id")
    at = lambda rows: F.when(rows, moment)
    accepted = lambda kind: at((F.col("kind") == kind) & F.col("_ok"))
    marks = log.groupBy(*PAIR).agg(
        F.max_by("kind", at(toggle.isNotNull())).alias("_last"),
        F.max(at(F.col("kind") == "unsave")).alias("_unsaved"),
        F.max(at((F.col("kind") == "save") & ~F.col("_saved_now"))).alias("_inserted"),  # a save that really inserts
        F.max_by(F.struct(F.nullif(strip("value"), F.lit("")).alias("v"), moment.alias("at")), accepted("note")).alias("_note"),
        F.max_by(F.struct(F.col("value").alias("v"), moment.alias("at")), accepted("status")).alias("_status"))
    # The last edit counts unless the row was forgotten after it.
    fresh = lambda c: F.col(c).isNotNull() & (F.col("_unsaved").isNull() | (F.col(f"{c}.at") > F.col("_unsaved")))
    full = state.withColumn("_held", F.lit(True)).join(marks, PAIR, "full_outer")
    alive = full.filter(F.coalesce(F.col("_last") == "save", F.col("_last").isNull() & F.col("_held"), F.lit(False)))
    stayed = F.coalesce("_held", F.lit(False)) & F.col("_unsaved").isNull()
    rows = alive.select(
        *PAIR, F.when(stayed, F.col("saved_at")).otherwise(F.col("_inserted.ts")).alias("saved_at"), F.when(stayed, F.col("sort_position")).alias("sort_position"),
        F.when(fresh("_note"), F.col("_note.v")).when(stayed, F.col("notes")).alias("notes"),
        F.coalesce(F.when(fresh("_status"), F.col("_status.v")), F.when(stayed, F.col("bid_status")), F.lit("reviewing")).alias("bid_status"),
        (stayed & F.coalesce("kept", F.lit(False))).alias("kept"))
    return rows, log.filter(~F.col("_ok")).select(*changes.columns)


def saved_list(state: DataFrame) -> DataFrame:
    """The saved list of a state: new saves stand behind the kept rows, in the order in which they were saved."""
    tops = state.filter("kept").groupBy("contractor_id").agg(F.max(F.coalesce("sort_position", F.lit(-1))).alias("_top"))
    added = rank_rows(state.filter("not kept"), ["contractor_id"], [F.col("saved_at"), F.col("notice_id")],
                      [(F.date_trunc("hour", "saved_at"), True)], "_rank").join(tops, "contractor_id", "left") \
        .withColumn("sort_position", (F.coalesce("_top", F.lit(-1)) + F.col("_rank")).cast("int")).drop("_rank", "_top")
    return state.filter("kept").unionByName(added).drop("kept")


def apply_saved_changes(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new saved list, rejected changes): a whole log folded into a saved list at once."""
    state, rejected = fold_saved_changes(saved_state(base), changes)
    return saved_list(state), rejected


def purge_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return child.join(parent.select(key), key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def ingest_status(df: DataFrame, corrupt: str | None = "_corrupt_record") -> DataFrame:
    """Adds `ingest_status`: failed (unreadable), skipped (no source or id) or upserted."""
    broken = F.col(corrupt).isNotNull() if corrupt and corrupt in df.columns else F.lit(False)
    missing = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("external_id", F.lit("")) == "")
    return df.withColumn("ingest_status", F.when(broken, "failed").when(missing, "skipped").otherwise("upserted"))


def ingest_counts(df: DataFrame) -> DataFrame:
    return ingest_status(df).groupBy("ingest_status").agg(F.count(F.lit(1)).alias("n"))
