"""One query per operator on the driver's tables, with DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm import (anchor_negatives, best_fit_packing, decontaminate, html_extract, mixing, near_dedup,
                           quality_classifier, quality_rules, sharding, span_dedup, spelling_variants, toxicity, warc)
from trajectra.llm.common import table
from trajectra.llm.oracle import ORACLE


# The labels have one toxicity category; low quality stands before it in the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a classifier chain."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes; equal texts stay together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the verdict."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of each document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of each document and its host."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 10))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return span_dedup.deduplicate_spans(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the sources, in training order."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; some labels are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return anchor_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with the more frequent word one letter away, and the root of such steps."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    import public_tokenizers
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_toxicity, op3_sharding, op4_warc, op5_decontamination, op6_near_dedup,
                            op7_quality_rules, op8_span_dedup, op9_mixing, op10_quality, op11_hard_negatives,
                            op12_spelling_variants, op13_best_fit_packing)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
