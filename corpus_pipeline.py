"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common, decontaminate, jaccard_join, language, mixing, queries, secrets


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones.

    Null texts and texts without a letter (empty ones among them) go, as do rejected ones; repeated rows are judged alike.
    """
    return language.keep_identified(docs, queries.identifier(spark, sf_dir))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest key, ties by the smallest hash of the text.

    Texts without words (null and empty ones) all stay; of repeated rows one stays.
    """
    return jaccard_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none, repeated rows fare alike."""
    return decontaminate.remove_contaminated(docs, common.table(sf_dir, "benchmark", spark))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [secret] in place of each secret; n_chars follows the text. Null texts stay null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, with size, source_size, target, repeats and taken beside the columns of documents.

    Texts without words (null and empty ones) are never taken; a null source is a source of its own; ties of size are
    broken by a seeded hash of the key.
    """
    return mixing.take(docs)


STAGES = [("language id", identified), ("n-gram jaccard join", unlike), ("benchmark decontamination", uncontaminated), ("secret scans", redacted), ("mixing to target weights", mixed)]

#: SQL expresses neither the language models nor the knapsack; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the mix after all stages; an empty table of documents gives an empty result. Extra columns pass on."""
    docs = common.table(sf_dir, "documents", spark)
    before = None
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
