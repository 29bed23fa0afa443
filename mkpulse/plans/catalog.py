"""Registry of named queries: a Spark plan and its DuckDB oracle.

``register(name, sql, adapters)`` records one query. ``build(t)`` returns the
Spark DataFrame; the oracle SQL gets the adapter CTEs it names prepended.
``finalize`` makes outputs comparable across engines: dates and timestamps as
ISO strings, doubles rounded half-away-from-zero to 6 places (two-step, see
``functions.rnd``). The oracle SQL applies the same rules with ``R()``/``DS()``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.functions import rnd
from mkpulse.plans.adapters import with_adapters
from mkpulse.session import Tables


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, adapters: tuple[str, ...] | list[str] = (), headline: bool = False):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = with_adapters(sql, *adapters) if (sql and adapters) else sql
        REGISTRY[name] = Entry(name, fn, full, headline)
        return fn

    return deco


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rnd(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def R(x: str, digits: int = 6) -> str:
    """SQL twin of ``functions.rnd`` for DuckDB."""
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,{digits + 3})), {digits}) AS DOUBLE)"


def DS(x: str) -> str:
    """SQL: DATE/TIMESTAMP -> ISO string."""
    return f"CAST(({x}) AS VARCHAR)"


def run(name: str, spark, sf_dir: str) -> DataFrame:
    return finalize(REGISTRY[name].build(Tables(spark, sf_dir)))
