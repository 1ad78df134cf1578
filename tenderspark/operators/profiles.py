"""Contractor profile as the form shows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.common import strip
from tenderspark.operators.ranking import first_by


def profile_view(contractors: DataFrame, past: DataFrame) -> DataFrame:
    """Arrays as comma lists, past work without a client as one text, distinct clients in their first spelling.

    The text of one contractor is one field of one row, so it is put together in one place.
    """
    client = strip(F.coalesce("client", F.lit("")))
    head = F.when(F.coalesce("project_name", F.lit("")).isin("", "Experience profile"), "").otherwise(F.concat(F.lit("**"), "project_name", F.lit("**\n")))
    told = past.filter(client == "").select("contractor_id", "project_id", strip(F.concat(head, F.coalesce("description", F.lit("")))).alias("t")).filter("t <> ''")
    story = told.groupBy("contractor_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "t"))).alias("x")) \
        .select("contractor_id", F.array_join(F.transform("x", lambda e: e["t"]), "\n\n").alias("_story"))
    named = past.select("contractor_id", "project_id", client.alias("client"), F.lower(client).alias("key")).filter("client <> ''")
    once = first_by(named, ["contractor_id", "key"], [F.col("project_id")])
    clients = once.groupBy("contractor_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "client"))).alias("x")) \
        .select("contractor_id", F.array_join(F.transform("x", lambda e: e["client"]), ", ").alias("_clients"))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return contractors.join(story, "contractor_id", "left").join(clients, "contractor_id", "left").select(
        "contractor_id", listed("industries").alias("industries"), listed("sub_industries").alias("sub_industries"), text("goals").alias("goals"),
        text("_story").alias("past_experience"), text("_clients").alias("past_clients"), listed("preferred_locations").alias("preferred_locations"),
        text("preferred_contract_min").alias("contract_min"), text("preferred_response_window_days").alias("window_days"),
        "certifications", "set_aside_eligibility", listed("naics_codes").alias("naics_codes"), listed("exclusions").alias("exclusions"))
