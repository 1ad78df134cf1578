"""The registered queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm import boundary, bpe, chat, checks, collocation, descent, forest, hnsw, huffman, lines, merkle, mixing, packing, quality
from tenderspark.llm.common import read
from tenderspark.llm.tokens import vocabulary

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
TRAINING_ROWS = 2500
AMBIGUOUS = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(VOCABULARY)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", AMBIGUOUS), (-1, 1, "assistant", AMBIGUOUS)], "conv_id long, turn long, role string, text string")
    return chat.read_chats(chat.format_chats(turns.unionByName(extra), path), path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "position", "slot", "block")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(VOCABULARY), capacity=2048)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    removed = lines.removed_lines(docs)
    return counts.join(removed, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(read(spark, sf_dir, "documents"), vocabulary(VOCABULARY), limit=512)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels"), TRAINING_ROWS), threshold=0.3)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8)


def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_ids(spark, huffman.write_ids(read(spark, sf_dir, "documents"), vocabulary(VOCABULARY)))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents"), least=10, top=2000)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_hash(*fields, lowered))
    return merkle.verified(merkle.manifest(docs, "source", "doc_id", [*fields, F.col("text")], tampered)).withColumnRenamed("key", "doc_id")


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(WORD_VOCABULARY)
    return boundary.digests(boundary.decode(boundary.encode(read(spark, sf_dir, "documents"), path), path))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_mixing, op3_best_fit_packing, op4_line_dedup, op5_nearest_neighbours, op6_embedding_near_dedup,
                                    op7_token_counts, op8_quality_classifier, op9_ngram_jaccard_join, op10_token_binary_output, op11_phrase_collocations, op12_merkle_manifest, op13_bpe_encoding, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": checks.COLLOCATIONS, "op12_merkle_manifest": checks.MERKLE}
