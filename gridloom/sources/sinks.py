"""Writers: tables, series, bundles, case components, payloads and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.case import CaseComponent
from ..operators.contracts import with_attributes

COMPONENT_TABLES = ("data", "parameter", "membership")


def write_table(df: DataFrame, path: str, **attributes: str) -> None:
    """Parquet table; attributes travel in the uid column's metadata."""
    (with_attributes(df, **attributes) if attributes else df).write.mode("overwrite").parquet(path)


def write_series(df: DataFrame, path: str, partition: str = "class") -> None:
    """Compressed long series, one folder per class. The commit protocol replaces it at once."""
    df.write.mode("overwrite").partitionBy(partition).option("compression", "zstd").parquet(path)


def write_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}")


def write_component(component: CaseComponent, root: str) -> None:
    for name in COMPONENT_TABLES:
        getattr(component, name).write.mode("overwrite").parquet(f"{root}/{name}")


def read_component(spark: SparkSession, root: str) -> CaseComponent:
    return CaseComponent(*[spark.read.parquet(f"{root}/{name}") for name in COMPONENT_TABLES])


def is_complete(spark: SparkSession, paths: list[str]) -> bool:
    """Whether every table of a case was committed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")
        if not path.getFileSystem(conf).exists(path):
            return False
    return True


def write_payload(rows: DataFrame, path: str) -> None:
    """Gzip text, one compact JSON document per row."""
    text = rows if rows.dtypes == [("value", "string")] else rows.select(
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
    )
    text.write.mode("overwrite").option("compression", "gzip").text(path)


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """Validation report: one JSON row per record with its section, so no section is gathered."""
    out = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").partitionBy("section").text(path)


def write_result(series: DataFrame, summary: DataFrame, root: str) -> None:
    """Dispatch series by component and its one-row summary."""
    series.write.mode("overwrite").partitionBy("component").option("compression", "zstd").parquet(f"{root}/timeseries")
    summary.write.mode("overwrite").json(f"{root}/summary")


def read_result(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/timeseries"), spark.read.json(f"{root}/summary")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
