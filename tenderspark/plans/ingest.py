"""Raw notices -> processed records -> notice table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.functions import normalize as nz
from tenderspark.functions.derive import deliverables, detect_location, short_name, statement_of_work
from tenderspark.functions.text import clean_description, override_admin_description
from tenderspark.operators import documents as docs
from tenderspark.operators import maintenance as mt
from tenderspark.operators import tagging as tg
from tenderspark.operators.departments import canonical_department
from tenderspark.sources.raw import in_processed_order, joined_objects, metadata_text

KEYS = ["source", "external_id"]
OVERWRITE = ["deliverables", "tags", "metadata"]
COMPARED = ["title", "description", "department", "due_date", "location", "contact_name", "contact_email", "contact_phone"]


def normalize(df: DataFrame, aliases: DataFrame, mode: str = "fuzzy") -> DataFrame:
    """Canonical header fields and cleaned description; other columns pass through."""
    named = canonical_department(df, aliases, "dept", mode, out="_dept")
    fixed = {"source": nz.canonical_source("source"), "status": nz.canonical_status("status"), "dept": F.col("_dept"),
             "title": nz.clean_title("title"), "description": clean_description("description"),
             "contact_phone": nz.canonical_phone("contact_phone"), "contact_email": nz.canonical_email("contact_email"),
             "contact_name": nz.contact_name("contact_name")}
    return named.withColumns(fixed).select(*df.columns)


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Metadata members the enrichment reads, as columns."""
    m = F.col("metadata")
    none = F.array().cast("array<string>")
    return df.withColumns({
        "event_type": m["event_type"], "solicitation_number": m["solicitation_number"],
        "meeting_location": m["mandatory_bidder_conference"]["location"],
        "code_descriptions": F.coalesce(F.transform(m["unspsc_codes"], lambda c: c["description"]), none),
        "labels": F.coalesce(F.transform(m["documents"], lambda d: d["label"]), none), "documents": m["documents"]})


def enrich(df: DataFrame, tagger: tg.Tagger | None = None, transform_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds location, name, statement_of_work, deliverables and tags.

    Tags come from `tagger`, else from the weak labels.  `transform_fn` takes
    the enriched table and returns the final one, e.g. joined with outside texts.
    """
    located = detect_location(df.withColumn("name", F.lit(None).cast("string")))
    named = located.withColumn("name", short_name("title", "dept"))
    described = deliverables(statement_of_work(named))
    featured = described.withColumn("feature_text", tg.feature_text(F.col("description"), F.col("title"), F.col("dept"), F.col("labels")))
    if tagger is None:
        tagged = tg.weak_labels(featured, out="tags")
    else:
        tagged = tagger.predict(featured, "feature_text", "tags")
    out = tagged.withColumn("tags", tg.append_location(F.slice("tags", 1, 4), F.col("location"))).drop("feature_text")
    return transform_fn(out) if transform_fn else out


def with_attachments(raw: DataFrame, attachments: DataFrame) -> DataFrame:
    """Raw records with what their attachments say.

    A blank description is filled with the best text; the five best texts go to
    `document_text`, and with their labels to the metadata.  `attachments` has
    source, external_id and the columns of `operators.documents`.
    """
    ident = F.to_json(F.struct(*KEYS)).alias("notice_id")
    files = attachments.select(ident, *[c for c in attachments.columns if c not in (*KEYS, "notice_id")])
    named = docs.backfill_description(raw.select(ident, *[c for c in raw.columns if c != "notice_id"]), files)
    texts = docs.concat_documents(files)
    listed = docs.rank_documents(files, include_addenda=True, readable_only=True).groupBy("notice_id") \
        .agg(F.array_sort(F.collect_list(F.struct("rank", "label", F.left("text", F.lit(docs.MAX_DOCUMENT_CHARS)).alias("text")))).alias("_texts"))
    found = texts.join(listed, "notice_id", "left")
    said = F.when(F.col("document_text").isNotNull(), F.to_json(F.struct(
        F.transform("_texts", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("extracted_document_texts"),
        F.col("document_text").alias("extracted_document_text"))))
    return (named.join(found, "notice_id", "left").withColumn("metadata_json", joined_objects(metadata_text(named), said))
            .drop("notice_id", "_texts"))


def process(raw: DataFrame, aliases: DataFrame, tagger: tg.Tagger | None = None,
            transform_fn: Callable[[DataFrame], DataFrame] | None = None, mode: str = "fuzzy", attachments: DataFrame | None = None) -> DataFrame:
    """Raw records (with flattened metadata) -> processed records in their column order."""
    if attachments is not None:
        raw = with_attachments(raw, attachments)
    enriched = enrich(normalize(raw, aliases, mode), tagger, transform_fn)
    return in_processed_order(override_admin_description(enriched))


def ingest(base: DataFrame, processed: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(new notice table, amendment records) from processed records; `at` is the time of the run.

    Records of one notice count in the order of their files' names, as if each
    were merged after the other.
    """
    arrived = F.col("file_name") if "file_name" in processed.columns else F.lit("")
    rows = mt.to_notice_row(processed.withColumn("_arrived", arrived), keep=("_arrived",)).withColumn("_hash", F.coalesce("content_hash", F.lit("")))
    latest = mt.fold_updates(rows, KEYS, ["_arrived", "_hash"], OVERWRITE)
    if "last_amended_at" in base.columns:  # a null keeps what the base has
        latest = latest.withColumn("last_amended_at", F.lit(None).cast("timestamp"))
    table = mt.merge_amended(base, latest, KEYS, OVERWRITE, F.lit(at).cast("timestamp"))
    return table, mt.amendments(base, latest, KEYS, COMPARED)
