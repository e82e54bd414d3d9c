"""Documents to training order: toxic ones out, one of each near-duplicate group, no benchmark passages, no personal data, mixed by source.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame. All but the last
return the columns of documents; the last adds each document's words, its source's target and when it is trained on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voc_spark.llm import decontaminate, mixing, pii, simhash, toxicity_crf
from voc_spark.llm.common import table
from voc_spark.sources.parquet import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span field scores below 0.5."""
    return toxicity_crf.without_toxic(docs, toxicity_crf.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars still counts the text as it came."""
    return pii.redact(docs, pii.fit(pii.seed_table(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which they are first trained on; those not taken, without a position, come first."""
    return mixing.mix(docs.select(*COLUMNS, mixing.words().alias("size")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: Fitted models and components over links can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole documents table, each stage's rows stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
