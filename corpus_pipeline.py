"""The corpus pipeline: filters, deduplication, decontamination and tokens of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialframe.llm import bpe, decontaminate, line_spread, simhash, toxicity
from trialframe.llm.catalog import BATCH_ROWS, table, vocabulary
from trialframe.sources.scratch import fresh_path


def _bounded(spark: SparkSession) -> None:
    """Small batches of texts to the Python workers, which stay for all stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; n_chars follows the text."""
    _bounded(spark)
    cleaned = line_spread.remove_boilerplate(docs, counts=False)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return bpe.digests(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", clean_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the machine of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
