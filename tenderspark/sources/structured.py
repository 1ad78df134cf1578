"""Checks of structured replies that come back from an outside service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.common import strip

_CITED = "citation struct<quote string>"
_FACT = f"array<struct<label string, detail string, {_CITED}>>"

SUMMARY_SCHEMA = (
    "opportunity_posture string, opportunity_posture_citations array<struct<quote string>>, "
    "scope_of_work string, scope_of_work_citations array<struct<quote string>>, "
    f"critical_deadlines array<struct<label string, date string, {_CITED}>>, "
    f"evaluation_criteria array<struct<name string, description string, weight_pct double, {_CITED}>>, "
    f"contract_details {_FACT}, technical_work_areas {_FACT}, submission_guidance {_FACT}, points_of_contact {_FACT}")


def _json_part(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _string_at(doc: Column, path: str) -> Column:
    """The value at `path` when it is a JSON string."""
    node = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(doc, path, "string"))


def valid_answer(df: DataFrame, text: str) -> DataFrame:
    """Adds `answer` (description, statement_of_work) and `valid`: both must be non-blank strings."""
    parsed = df.withColumn("_doc", F.try_parse_json(_json_part(F.col(text))))
    answer = parsed.withColumn("answer", F.struct(
        strip(_string_at(F.col("_doc"), "$.description")).alias("description"),
        strip(_string_at(F.col("_doc"), "$.statement_of_work")).alias("statement_of_work")))
    valid = (F.col("answer.description") != "") & (F.col("answer.statement_of_work") != "")
    return answer.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_doc")


def valid_summary(df: DataFrame, text: str) -> DataFrame:
    """Adds `summary` and `valid`: every field of the summary schema present, array members complete.

    The percent weight of a criterion alone may be null.
    """
    parsed = df.withColumn("summary", F.from_json(text, SUMMARY_SCHEMA))
    s = F.col("summary")

    def cited(x: Column, *names: str) -> Column:
        ok = x["citation"]["quote"].isNotNull()
        for name in names:
            ok = ok & x[name].isNotNull()
        return ok

    checks = [s["opportunity_posture"].isNotNull(), s["scope_of_work"].isNotNull()]
    for name in ("opportunity_posture_citations", "scope_of_work_citations"):
        checks.append(F.forall(s[name], lambda x: x["quote"].isNotNull()))
    checks.append(F.forall(s["critical_deadlines"], lambda x: cited(x, "label", "date")))
    checks.append(F.forall(s["evaluation_criteria"], lambda x: cited(x, "name", "description")))
    for name in ("contract_details", "technical_work_areas", "submission_guidance", "points_of_contact"):
        checks.append(F.forall(s[name], lambda x: cited(x, "label", "detail")))
    valid = checks[0]
    for check in checks[1:]:
        valid = valid & check
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))
