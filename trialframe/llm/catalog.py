"""The operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    angular_negatives, ann, automaton_search, bpe, decontaminate, html_region, langid, line_spread, pii, quality_rules, simhash,
    toxicity, url_trust,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Rows of a batch that goes to a Python worker; rows here are whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables. Reading it also bounds the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Place of the rank file, and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@_query("op1_html_region")
def _op1(spark, folder):
    return html_region.main_texts(table(spark, folder, "pages"))


@_query("op2_line_spread", line_spread.SQL)
def _op2(spark, folder):
    return line_spread.remove_boilerplate(table(spark, folder, "documents"), keep=["doc_id", "text"])


@_query("op3_learned_partitions")
def _op3(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"), "id % 20 = 0")


@_query("op4_qgram_decontamination")
def _op4(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op5_language_masks")
def _op5(spark, folder):
    return langid.held_out_languages(table(spark, folder, "documents"))


@_query("op6_toxicity")
def _op6(spark, folder):
    return toxicity.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op7_contextual_pii")
def _op7(spark, folder):
    return pii.report(table(spark, folder, "documents"))


@_query("op8_simhash_trie")
def _op8(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query("op9_byte_bpe")
def _op9(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), *vocabulary()).drop("token_ids")


@_query("op10_url_trust")
def _op10(spark, folder):
    return url_trust.verdicts(table(spark, folder, "pages")).drop("trust", "distrust")


@_query("op11_quality_rules")
def _op11(spark, folder):
    return quality_rules.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op12_angular_negatives", angular_negatives.SQL)
def _op12(spark, folder):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return angular_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved), "id % 50 = 0")


@_query("op13_automaton_search", automaton_search.SQL)
def _op13(spark, folder):
    return automaton_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
