"""Tag queries over the whole documents."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.catalog.cleaning import _q
from tenderspark.catalog.registry import query
from tenderspark.catalog.tables import TABLES
from tenderspark.fixed import FAMILY_TAGS, KEYWORD_RULES, TAG_VOCABULARY
from tenderspark.functions.derive import detect_location
from tenderspark.operators import tagging as tg
from tenderspark.session import scratch_path, stage

TABLES["tag_sources"] = """select d.doc_id, d.title, d.dept, d.labels, d.meeting_location, case d.doc_id % 6 when 0 then 'Install a database server. ' when 1 then 'Court budget development and hardware. ' when 2 then 'UNSPSC: 85101500 and 72101500. '
 when 3 then 'Cloud-based saas, gis maps. ' when 4 then 'UNSPSC 20260101 43211500 ' else '' end || coalesce(d.description, '') as description from {descriptions} d"""

_FEATURE = """(select doc_id, description, lower(concat_ws(chr(10), nullif(description, ''), nullif(description, ''), nullif(title, ''), nullif(dept, ''), replace(array_to_string(list_filter(labels, lambda x: x <> ''), chr(10)), '_', ' '))) as ft from {tag_sources})"""
_RULES = "(values " + ", ".join(f"({_q(n)}, {_q(tag)})" for n, tag in KEYWORD_RULES) + ") as ru(needle, tag)"
_FAMILIES = "(values " + ", ".join(f"({_q(n)}, {_q(tag)})" for n, tag in FAMILY_TAGS) + ") as fa(family, tag)"
_VOCAB = "(values " + ", ".join(f"({_q(tag)}, {i})" for i, tag in enumerate(TAG_VOCABULARY)) + ") as vo(tag, pos)"
_CODE_TAGS = f"""(select doc_id, fa.tag from (select doc_id, unnest(regexp_extract_all(regexp_extract(description, '(?is)unspsc(.{{0,60}})', 1), '\\b\\d{{8}}\\b')) as code from {{tag_sources}})
 join {_FAMILIES} on fa.family = substr(code, 1, 2) where cast(code as int) not between 19000000 and 21000000)"""
_LABELS = f"(select doc_id, tag from {_FEATURE}, {_RULES} where contains(ft, needle) union select doc_id, tag from {_CODE_TAGS})"


def _sources(t):
    return t.tag_sources.withColumn("feature_text", tg.feature_text(F.col("description"), F.col("title"), F.col("dept"), F.col("labels")))


@query("feature_text", f"select doc_id, ft as feature_text from {_FEATURE}")
def feature_text(t):
    return _sources(t).select("doc_id", F.lower("feature_text").alias("feature_text"))


@query("keyword_tags", f"select doc_id, string_agg(tag, '|' order by tag) as tags from (select distinct doc_id, tag from {_FEATURE}, {_RULES} where contains(ft, needle)) group by 1")
def keyword_tags(t):
    # Not a filter, which Spark would put below the tags, so that they are looked for twice.
    tags = F.array_join(F.array_sort(tg.keyword_tags(F.col("feature_text"))), "|")
    return _sources(t).select("doc_id", F.explode(F.filter(F.array(tags), lambda x: x != "")).alias("tags"))


@query("weak_labels", f"select doc_id, string_agg(tag, '|' order by tag) as tags from {_LABELS} group by 1")
def weak_labels(t):
    return tg.weak_labels(_sources(t)).select("doc_id", F.array_join("labels_found", "|").alias("tags")).filter("tags <> ''")


@query("tag_distribution", f"select tag, count(doc_id) as n from {_VOCAB} left join {_LABELS} using (tag) group by 1 union all select '(untagged)', count(*) from {{tag_sources}} where doc_id not in (select doc_id from {_LABELS})")
def tag_distribution(t):
    return tg.tag_distribution(tg.weak_labels(_sources(t)), "labels_found")


@query("selected_tags", f"""select doc_id, string_agg(tag, '|' order by r) as tags from (select *, row_number() over (partition by doc_id order by p desc, pos) as r, count(*) filter (p >= 0.5) over (partition by doc_id) as n from (
 select doc_id, tag, pos, ((doc_id * 31 + pos * 17 + (doc_id * pos) % 13) % 97) / 97.0 * case when doc_id % 3 = 0 then 0.6 when doc_id % 3 = 1 then 0.505 else 1.0 end as p from documents, {_VOCAB})) where r <= greatest(2, least(4, n)) group by 1""")
def selected_tags(t):
    doc = F.col("doc_id")
    scale = F.when(doc % 3 == 0, 0.6).when(doc % 3 == 1, 0.505).otherwise(1.0)
    scored = F.array(*[F.struct(((doc * 31 + pos * 17 + (doc * pos) % 13) % 97 / 97.0 * scale).alias("p"), F.lit(pos).alias("pos"), F.lit(tag).alias("tag"))
                       for pos, tag in enumerate(TAG_VOCABULARY)])
    return t.documents.select("doc_id", F.array_join(tg.select_tags(scored), "|").alias("tags"))


@query("tags_with_location", """select notice_id, array_to_string(case when location is null or list_contains(tags, location) then tags else list_append(tags, location) end, '|') as tags from {notices}""")
def tags_with_location(t):
    return t.notices.select("notice_id", F.array_join(tg.append_location(F.col("tags"), F.col("location")), "|").alias("tags"))


@query("documents_without_known_rule", f"select doc_id from {{tag_sources}} where doc_id not in (select doc_id from {_LABELS} where tag in (select tag from {_VOCAB}))")
def documents_without_known_rule(t):
    """Rule check on the data: no label may lie outside the vocabulary."""
    labelled = tg.weak_labels(_sources(t)).select("doc_id", F.explode("labels_found").alias("tag"))
    known = labelled.join(tg.bad_rules(t.spark), "tag", "left_anti").select("doc_id").distinct()
    return t.tag_sources.select("doc_id").join(known, "doc_id", "left_anti")


@query("tagger_predictions")
def tagger_predictions(t):
    labelled = detect_location(tg.weak_labels(_sources(t)).withColumn("name", F.lit(None).cast("string")))
    tagger = tg.Tagger.train(labelled, "feature_text", "labels_found")
    return tagger.predict(labelled, "feature_text").select("doc_id", F.array_join(tg.append_location(F.col("tags"), F.col("location")), "|").alias("tags"))


@query("tagger_gate", """select step, action, (select count(*) from documents) as n_tagged from (values ('first', 'trained'), ('again', 'loaded'), ('other rules', 'trained'), ('same rules', 'loaded')) v(step, action)""")
def tagger_gate(t):
    """Whether a stored tagger is used: not when the hash of the rules that it was trained under differs from theirs now."""
    folder, labelled = scratch_path(t.spark, "tagger"), stage(tg.weak_labels(_sources(t)), "labelled")
    steps = []
    for step in ("first", "again", "other rules", "same rules"):
        if step == "other rules":
            kept = t.spark.read.parquet(f"{folder}/settings").first()
            t.spark.createDataFrame([("0" * 16, *kept[1:])], "rules string, constants string, scaling array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")
        tagger, action = tg.load_or_train(labelled, "feature_text", "labels_found", folder, max_iter=1)
        tagged = tagger.predict(labelled, "feature_text").filter(F.size("tags") >= 1).agg(F.count(F.lit(1)).alias("n_tagged"))
        steps.append(tagged.select(F.lit(step).alias("step"), F.lit(action).alias("action"), "n_tagged"))
    return reduce(DataFrame.unionByName, steps)
