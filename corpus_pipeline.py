"""Corpus pipeline: quality rules, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents. All but the last return the columns of `documents`. A stage works on everything
that its predecessor kept. Null or empty texts fail the quality rules; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, neardup, packing, quality, secrets
from gridloom.llm.common import TEXT_COLUMNS, shared_folder, table, written
from gridloom.session import in_few_files
from gridloom.llm.tokens import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go."""
    return in_few_files(quality.quality_verdicts(docs, keep=TEXT_COLUMNS).where("kept").select(*TEXT_COLUMNS))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.

    Rows are told apart by a number of their own, so different texts of one id, and rows without an id, are
    documents like all others. Of a group the smallest id stays, a null id last, then the smallest row.
    """
    rows = written(docs.select(*TEXT_COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows, width=5, percent=80, key="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    kept = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.__row")
    return in_few_files(rows.join(kept, "__row", "left_semi").select(*TEXT_COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return in_few_files(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*TEXT_COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact_secrets(docs.select(*TEXT_COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
#: Quantile sketches, signatures and tokenizer ids are out of SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
