"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it kept, and returns a
DataFrame; run() writes each stage's rows as Parquet and reads them back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ebbmark.core.tables import table
from ebbmark.llm import decontam, line_dedup, near_dedup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs).drop("n_lines_removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Learned cutoffs, token ids and schedules are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
