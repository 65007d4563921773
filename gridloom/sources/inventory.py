"""File inventory: size, checksum and acquisition status of catalog entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "path string, size_bytes long, checksum string"


def scan_files(spark: SparkSession, root: str, algorithm: str = "md5") -> DataFrame:
    """Files under a folder with size and checksum; the bytes stay in the tasks."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size_bytes"), digest(F.col("content"), algorithm).alias("checksum"))


def digest(content: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"Unsupported checksum algorithm {algorithm!r}.")


def status_report(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog entries against found files.

    catalog: source_id, path, file_name, acquisition_method, checksum_algorithm, expected_checksum,
    credentials. files: path, file_name, size_bytes, checksum, valid. An entry is found at its own
    path, or as a candidate with its file name elsewhere.
    """
    at_path = files.select("path", F.col("size_bytes").alias("own_size"), F.col("checksum").alias("own_sum"), F.col("valid").alias("own_valid"), F.lit(True).alias("exists"))
    here = catalog.join(at_path, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    named = (
        files.select("file_name", F.col("path").alias("c_path"), F.col("size_bytes").alias("c_size"), F.col("checksum").alias("c_sum"), F.col("valid").alias("c_valid"))
        .groupBy("file_name").agg(
            F.count("*").alias("candidates"), F.min_by(F.struct("c_path", "c_size", "c_sum", "c_valid"), "c_path").alias("c"),
        )
    )
    d = here.join(named, "file_name", "left")
    candidates = F.when(F.col("exists"), 0).otherwise(F.coalesce("candidates", F.lit(0)))
    single = candidates == 1
    checked = F.col("exists") | single
    pick = lambda own, cand: F.when(F.col("exists"), F.col(own)).when(single, F.col(cand))
    configured = (F.coalesce("checksum_algorithm", F.lit("")) != "") & (F.coalesce("expected_checksum", F.lit("")) != "")
    found = F.when(configured, pick("own_sum", "c.c_sum"))
    good = (F.coalesce("expected_checksum", F.lit("")) == "") | (F.lower(F.coalesce(found, F.lit(""))) == F.lower("expected_checksum"))
    invalid = checked & ~F.coalesce(pick("own_valid", "c.c_valid"), F.lit(True))
    status = (
        F.when(invalid, "invalid_source_file").when(F.col("exists") & good, "available").when(F.col("exists"), "checksum_mismatch")
        .when(candidates > 1, "multiple_local_candidates").when(single & good, "local_path_mismatch").when(single, "candidate_checksum_mismatch")
        .when(F.col("acquisition_method") == "manual", "manual_action_required")
        .when((F.col("acquisition_method") == "atlite_cds") & ~F.coalesce("credentials", F.lit(False)), "credentials_required")
        .otherwise("ready_to_download")
    )
    return d.select(
        "source_id", "path", status.alias("status"), (status == "available").alias("available"), pick("own_size", "c.c_size").alias("size_bytes"),
        F.coalesce(found, F.lit("")).alias("checksum"), F.when(candidates > 0, F.col("c.c_path")).alias("detected_path"),
    )
