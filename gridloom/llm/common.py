"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, in_few_files, in_fewest_files

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"
TEXT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: computed once, lineage cut, compressed."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_few(df: DataFrame, label: str) -> DataFrame:
    """`written`, in few files however many shuffle partitions there are."""
    return written(in_few_files(df), label)


def written_fewest(df: DataFrame, label: str) -> DataFrame:
    """`written_few` for rows of a few numbers."""
    return written(in_fewest_files(df), label)


def cut(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Words between runs of U+0020 and U+0009 to U+000D; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def fenced(df: DataFrame) -> DataFrame:
    """Keep the optimizer from merging later filters and projections into the columns computed so far.

    A filter on a derived column is otherwise pushed below it, and an array that a lambda reads is then
    computed again for each of its elements. Drop `__fence` afterwards.
    """
    return df.drop("__fence").withColumn("__fence", F.monotonically_increasing_id()).where("__fence >= 0")
