"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.llm import decontaminate, mixing, near_dup, pii, toxicity
from sonarmill.session import bounded_batches, cut

#: Near-duplicates in the pipeline: 5-word shingles, 80 percent.
NEAR_PERCENT = 80


def _without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``verdict`` go; rows without an id stay."""
    return docs.join(cut(verdict.select("doc_id").distinct(), "verdict"), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``toxicity.THRESHOLD`` or more go.

    Null and empty texts get the score of a text without hits and stay; rows that repeat a
    doc_id go together if one of them is rejected; without labels nothing goes.
    """
    bounded_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score(docs, model).where(F.col("score") >= toxicity.THRESHOLD))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id stays.

    Null, empty and wordless texts and rows without an id are in no group and stay; rows that
    repeat a doc_id are one document and stay or go together.
    """
    bounded_batches(spark)
    return _without(docs, near_dup.near_duplicates(docs, NEAR_PERCENT).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay, as does all if the benchmark is empty."""
    bounded_batches(spark)
    return _without(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars is that of the new text where it changed.

    Every row stays; null and empty texts stay as they are, of overlapping spans the first, then the longest, counts.
    """
    bounded_batches(spark)
    redacted = pii.redact(docs.withColumn("__text_before", F.xxhash64("text")), pii.learn(docs))
    changed = ~F.col("__text_before").eqNullSafe(F.xxhash64("text"))
    return redacted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as redacted, with its tokens, likeliest domain and rate.

    Null and empty texts have 0 tokens and a rate; of equally likely domains the first by name is named.
    """
    bounded_batches(spark)
    return mixing.mix(docs, keep=docs.columns)[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
]

#: The stages learn models and cluster; SQL can't state them. tests/llm holds each to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
