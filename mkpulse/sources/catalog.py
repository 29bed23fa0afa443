"""Catalog and ad-hoc access (S22-S24, Q06 helpers, V11 registration)."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def execute_query(spark: SparkSession, sql: str, params: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """Parametrised SQL (named ``:markers`` bound from ``params``, never
    string formatting); ``frames`` are referenced as ``{name}`` in the text."""
    return spark.sql(sql, args=dict(params or {}), **frames)


def preview(df: DataFrame, n: int = 1000, order_cols: str | list[str] | None = None, descending: bool = True) -> DataFrame:
    """First ``n`` rows, or the ``n`` newest / largest by ``order_cols``
    (a bounded top-k - each task keeps n rows; give a unique tie-break)."""
    if order_cols is None:
        return df.limit(n)
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    o = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in cols]
    return df.orderBy(*o).limit(n)


def list_tables(spark: SparkSession, pattern: str = "*") -> list[str]:
    """Names of registered tables / views matching a LIKE-style glob."""
    return sorted(t.name for t in spark.catalog.listTables() if fnmatch.fnmatch(t.name, pattern))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Column names and types of a table (metadata only)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(name).schema.fields]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table in ONE job (a union of global counts)."""
    out = None
    for name in sorted(tables):
        c = tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


def coverage(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per source rows, first and last date (either date format) and a
    load status, in one job."""
    from mkpulse.functions import to_day

    out = None
    for name in sorted(sources):
        df, date_col = sources[name]
        d = to_day(date_col)
        c = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(d).alias("min_date"), F.max(d).alias("max_date")).select(
            F.lit(name).alias("source"), "row_count", "min_date", "max_date",
            F.when(F.col("row_count") > 0, "loaded").otherwise("empty").alias("status"),
        )
        out = c if out is None else out.unionByName(c)
    return out
