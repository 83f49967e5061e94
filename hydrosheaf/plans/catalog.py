"""Registry of queries: Spark callables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy_output(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers, so both engines show the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(~F.isnan(c), c), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.DecimalType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; the SQL text stands next to the Spark code it checks."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy_output(fn(spark, sf_dir), digits)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def R(*cols: str, digits: int = 6) -> str:
    """round(...) list; ``expr AS name`` or a bare column name."""
    out = []
    for c in cols:
        e, _, n = c.rpartition(" AS ")
        out.append(f"round({e or c}, {digits}) + 0.0 AS {n if e else c}")
    return ", ".join(out)


def B(*cols: str) -> str:
    out = []
    for c in cols:
        e, _, n = c.rpartition(" AS ")
        out.append(f"CAST({e or c} AS BIGINT) AS {n if e else c}")
    return ", ".join(out)


def load() -> None:
    from hydrosheaf.plans import (  # noqa: F401
        q_analog, q_flow, q_freq, q_sheets, q_stats, q_tables, q_trend,
    )
FLAGSHIP = "x01_annual_extremes"
