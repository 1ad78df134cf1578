"""Category tags: weak labels, a trained tagger, selection and distribution."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, HashingTF, IDF, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tenderspark.fixed import FAMILY_TAGS, KEYWORD_RULES, TAG_VOCABULARY
from tenderspark.functions.common import drop_blank, let, literals, longest_of, lookup, strip
from tenderspark.functions.extract import commodity_codes

if TYPE_CHECKING:
    import pyarrow as pa

FEATURE_BITS = 18
# Rows up to which all fits may run side by side, and how many do beyond.
SMALL = 20_000
SPACE = 2


def feature_text(description: Column, title: Column, dept: Column, labels: Column) -> Column:
    """Description twice, title, department and attachment labels, one per line, blanks left out."""
    named = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    return F.array_join(drop_blank(F.concat(F.array(description, description, title, dept), named)), "\n")


def keyword_tags(text: Column, rules: tuple = KEYWORD_RULES) -> Column:
    """Tags whose rule text occurs, in rule order; one pass over the row, no join.

    One scan finds the longest needle that begins at each place; the needles that
    it begins with occur there as well.  Lines that come twice are scanned once.
    """
    needles = tuple(dict.fromkeys(needle for needle, _ in rules))
    if not any("\n" in needle for needle in needles):
        text = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    inner = [(n, [m for m in needles if m != n and n.startswith(m)]) for n in needles]
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({longest_of(needles)}))"), F.lit(1)))
    prefixes = F.flatten(F.transform(found, lambda n: F.split(lookup(n, [(n, "\u0003".join([n, *more])) for n, more in inner]), "\u0003")))
    held = let(prefixes, lambda hits: F.filter(literals(needles), lambda n: F.array_contains(hits, n)))
    return F.array_distinct(F.transform(held, lambda n: lookup(n, rules)))


def weak_labels(df: DataFrame, out: str = "labels_found") -> DataFrame:
    """Keyword tags together with the tags of commodity code families, sorted.

    Uses description, title, dept and labels.  The keywords are looked for in
    the feature text with the description once, which gives the same tags.
    """
    empty = F.lit(None).cast("string")
    once = let(feature_text(empty, F.concat_ws("\n", "description", "title"), F.col("dept"), F.col("labels")), keyword_tags)
    families = F.transform(commodity_codes(F.coalesce("description", F.lit(""))), lambda c: lookup(F.left(c, F.lit(2)), FAMILY_TAGS))
    return df.withColumn(out, F.array_sort(F.array_union(once, F.filter(families, lambda x: x.isNotNull()))))


def tag_distribution(df: DataFrame, labels: str, vocabulary=TAG_VOCABULARY) -> DataFrame:
    """(tag, n): rows per vocabulary tag, zero included, and `(untagged)` for rows without any."""
    found = F.when(F.size(labels) == 0, F.array(F.lit("(untagged)"))).otherwise(F.col(labels))
    counts = df.select(F.explode(found).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(1).select(F.explode(literals((*vocabulary, "(untagged)"))).alias("tag"))
    return every.join(counts, "tag", "left").select("tag", F.coalesce("_n", F.lit(0)).alias("n"))


def select_tags(scored: Column, lo: int = 2, hi: int = 4, floor: float = 0.5) -> Column:
    """Tags of an array<struct<p, pos, tag>>: those at or above `floor`, at most `hi`, filled up to `lo` by rank."""
    ranked = F.array_sort(F.transform(scored, lambda s: F.struct((-s["p"]).alias("q"), s["pos"].alias("pos"), s["tag"].alias("tag"))))

    def pick(r: Column) -> Column:
        sure = F.size(F.filter(r, lambda s: -s["q"] >= floor))
        return F.transform(F.slice(r, F.lit(1), F.greatest(F.lit(lo), F.least(F.lit(hi), sure))), lambda s: s["tag"])

    return let(ranked, pick)


def append_location(tags: Column, location: Column, cap: int = 5) -> Column:
    """Tags, then the location unless it is one of them, at most five."""
    missing = location.isNotNull() & (location != "") & ~F.array_contains(tags, location)
    return F.slice(F.when(missing, F.concat(tags, F.array(location))).otherwise(tags), 1, cap)


def bad_rules(spark: SparkSession, rules=KEYWORD_RULES + FAMILY_TAGS, vocabulary=TAG_VOCABULARY) -> DataFrame:
    """Rule tags that the vocabulary does not have; empty for a sound rule set."""
    used = spark.range(1).select(F.explode(literals(tag for _, tag in rules)).alias("tag")).distinct()
    known = spark.range(1).select(F.explode(literals(vocabulary)).alias("tag"))
    return used.join(known, "tag", "left_anti")


def rules_hash() -> str:
    """Changes with the vocabulary, the rules or the feature space; stored with a model and compared before it is used."""
    rules = {"vocabulary": TAG_VOCABULARY, "keywords": KEYWORD_RULES, "families": FAMILY_TAGS, "bits": FEATURE_BITS}
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:16]


def _log_counts(counted: DataFrame) -> DataFrame:
    """Sparse counts ``_c`` as 1 + log(count); whole Arrow batches, as a vector column has no SQL function for its values."""
    place = counted.columns.index("_c")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            vectors = batch.column(place)
            kind, size, indices, values = (vectors.field(k) for k in range(4))
            weights = pa.ListArray.from_arrays(values.offsets, pc.add(1.0, pc.ln(values.values)), type=values.type)
            columns = batch.columns
            columns[place] = pa.StructArray.from_arrays([kind, size, indices, weights], fields=list(vectors.type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return counted.mapInArrow(work, counted.schema)


class Tagger:
    """One balanced logistic regression per tag over hashed word and word-pair weights."""

    def __init__(self, scaling: DenseVector, models: dict[str, LogisticRegressionModel], constants: dict[str, float]):
        self.scaling, self.models, self.constants = scaling, models, constants

    @staticmethod
    def _counts(df: DataFrame, text: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[A-Za-z0-9_]{2,}", gaps=False).transform(df)
        kept = StopWordsRemover(inputCol="_w", outputCol="_k").transform(words)
        pairs = NGram(n=2, inputCol="_k", outputCol="_g").transform(kept).withColumn("_t", F.concat("_k", "_g"))
        counted = HashingTF(inputCol="_t", outputCol="_c", numFeatures=1 << FEATURE_BITS).transform(pairs)
        return _log_counts(counted.drop("_w", "_k", "_g", "_t"))

    def _features(self, counted: DataFrame) -> DataFrame:
        scaled = ElementwiseProduct(scalingVec=self.scaling, inputCol="_c", outputCol="_s").transform(counted)
        return Normalizer(inputCol="_s", outputCol="_f").transform(scaled).drop("_c", "_s")

    @classmethod
    def train(cls, df: DataFrame, text: str, labels: str, max_iter: int = 100, parallel: int = 8) -> "Tagger":
        import numpy as np

        # The counts are read twice and not kept, as they take more room than the texts.
        counted = cls._counts(df.select(text, labels), text).drop(text)
        seen = IDF(inputCol="_c", outputCol="_i").fit(counted)
        n, df_counts = seen.numDocs, np.asarray(seen.docFreq, dtype="float64")
        weight = np.where((df_counts > 0) & (df_counts <= 0.95 * n), np.log((1.0 + n) / (1.0 + df_counts)) + 1.0, 0.0)
        tagger = cls(DenseVector(weight), {}, {})
        featured = tagger._features(counted).select("_f", labels).persist()
        try:
            counts = featured.agg(*[F.count_if(F.array_contains(labels, t)).alias(f"t{i}") for i, t in enumerate(TAG_VOCABULARY)]).first()
            for i, tag in enumerate(TAG_VOCABULARY):
                if counts[f"t{i}"] in (0, n):
                    tagger.constants[tag] = float(counts[f"t{i}"] == n)

            def fit(tag: str) -> LogisticRegressionModel:
                positive = counts[f"t{TAG_VOCABULARY.index(tag)}"]
                target = F.array_contains(labels, tag)
                balanced = F.when(target, n / (2.0 * positive)).otherwise(n / (2.0 * (n - positive)))
                data = featured.select("_f", target.cast("double").alias("label"), balanced.alias("weight"))
                return LogisticRegression(featuresCol="_f", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=max_iter).fit(data)

            # The tags' fits share the cached features and run side by side, so the passes of one fill the gaps of another.
            # Each keeps a copy of the features while it runs, so no more than `SPACE` at once in large tables.
            open_ = [tag for tag in TAG_VOCABULARY if tag not in tagger.constants]
            with ThreadPoolExecutor(parallel if n <= SMALL else min(parallel, SPACE)) as pool:
                tagger.models = dict(zip(open_, pool.map(inheritable_thread_target(df.sparkSession)(fit), open_)))
        finally:
            featured.unpersist()
        return tagger

    def probabilities(self, df: DataFrame, text: str, out: str = "scored") -> DataFrame:
        """Adds an array<struct<p, pos, tag>> in vocabulary order."""
        featured = self._features(self._counts(df, text))
        entries = []
        for pos, tag in enumerate(TAG_VOCABULARY):
            model = self.models.get(tag)
            if model is None:
                p = F.lit(self.constants.get(tag, 0.0))
            else:
                model = model.copy().setFeaturesCol("_f").setProbabilityCol(f"_p{pos}").setRawPredictionCol("").setPredictionCol("")
                featured = model.transform(featured)
                p = vector_to_array(F.col(f"_p{pos}"))[1]
            entries.append(F.struct(p.alias("p"), F.lit(pos).alias("pos"), F.lit(tag).alias("tag")))
        return featured.withColumn(out, F.array(*entries)).select(*df.columns, out)

    def predict(self, df: DataFrame, text: str, out: str = "tags") -> DataFrame:
        """Adds two to four tags; a row without text gets the first two of the vocabulary."""
        scored = self.probabilities(df, text, "_scored")
        chosen = F.when(strip(F.coalesce(F.col(text), F.lit(""))) == "", literals(TAG_VOCABULARY[:2])).otherwise(select_tags(F.col("_scored")))
        return scored.withColumn(out, chosen).drop("_scored")

    def save(self, spark: SparkSession, folder: str) -> None:
        """The models and, last of all, the settings with the hash of the rules they were trained under."""
        for i, tag in enumerate(TAG_VOCABULARY):
            if tag in self.models:
                self.models[tag].write().overwrite().save(f"{folder}/tag-{i}")
        rows = [(rules_hash(), json.dumps(self.constants), [float(x) for x in self.scaling])]
        spark.createDataFrame(rows, "rules string, constants string, scaling array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Tagger":
        row = spark.read.parquet(f"{folder}/settings").first()
        constants = json.loads(row["constants"])
        models = {tag: LogisticRegressionModel.load(f"{folder}/tag-{i}") for i, tag in enumerate(TAG_VOCABULARY) if tag not in constants}
        return cls(DenseVector(row["scaling"]), models, constants)


def stored_rules(spark: SparkSession, folder: str) -> str | None:
    """The hash of the rules that the stored tagger was trained under; None without one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/settings").first()["rules"]
    except AnalysisException:
        return None


def load_or_train(df: DataFrame, text: str, labels: str, folder: str, max_iter: int = 100) -> tuple[Tagger, str]:
    """The stored tagger, if it was trained under the current rules, else a new one that takes its place; and `loaded` or `trained`."""
    spark = df.sparkSession
    if stored_rules(spark, folder) == rules_hash():
        return Tagger.load(spark, folder), "loaded"
    tagger = Tagger.train(df, text, labels, max_iter)
    tagger.save(spark, folder)
    return tagger, "trained"
