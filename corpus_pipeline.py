"""A training corpus from `documents`: quality, repeated lines, near duplicates, mixture, packed sequences.

Each stage takes what the one before kept, as written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm import forest, lines, mixing, packing, quality
from tenderspark.llm.common import Scratch, read
from tenderspark.llm.queries import TRAINING_ROWS, VOCABULARY
from tenderspark.llm.tokens import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  It learns from the labelled rows of `documents`."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), TRAINING_ROWS)
    return quality.accepted(docs, model, threshold=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents in which nothing else stood.  ``n_chars`` follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return forest.without_near_duplicates(docs, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, the rows and files in the order of the mixture."""
    return mixing.mix(docs).sort("position").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of all documents.  The files of the mixture are the parts, by the numbers Spark gave them, so sequences are numbered along the mixture."""
    number = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1)
    part = F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))
    return packing.pack_documents(docs, vocabulary(VOCABULARY), capacity=2048, part=part)


STAGES = [("quality", classify), ("lines", dedup_lines), ("near duplicates", near_duplicates), ("mixture", mix), ("packing", pack)]

#: The classifier, the line and the near-duplicate stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written under ``spark.checkpoint.dir`` and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
