"""Registered queries: each has a Spark plan and, where SQL can state it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"Query {name!r} is registered twice.")
        REGISTRY[name] = Query(name, plan, with_views(sql) if sql else None)
        return plan

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps as text: a form in which two engines can be compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from . import queries_case, queries_network, queries_parameters, queries_series, queries_sources, queries_spatial, queries_units  # noqa: F401

    return REGISTRY
