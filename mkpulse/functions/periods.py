"""Date ranges and period tagging.

All operators take an explicit ``as_of`` date instead of "today". Filters are
plain range predicates on the date column, so on a table partitioned by date
they prune partitions and otherwise reach the parquet reader as pushed filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.functions import col

# fixed values: the preset windows offered by the period picker (days)
PRESET_DAYS = (7, 14, 30, 60, 90, 180, 365)
# fixed values: comparison offsets in days
COMPARE_OFFSETS = {"wow": 7, "mom": 30, "yoy": 365}


def as_date(d: str | dt.date) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def etl_range(as_of, days: int | None = None, start=None, end=None, lifetime_start=None):
    """Load window. lifetime -> (lifetime_start, yesterday); start given ->
    (start, end or yesterday); else the last ``days`` days ending yesterday."""
    y = as_date(as_of) - dt.timedelta(days=1)
    if lifetime_start is not None:
        return as_date(lifetime_start), y
    if start is not None:
        return as_date(start), as_date(end) if end is not None else y
    n = 30 if days is None else days
    return y - dt.timedelta(days=n - 1), y


def social_range(as_of, days: int | None = 30, lifetime: bool = False):
    """Social-ads variant: lifetime = last 400 days; else [today-days, today]."""
    t = as_date(as_of)
    return (t - dt.timedelta(days=400), t) if lifetime else (t - dt.timedelta(days=days or 30), t)


def preset_range(as_of, days: int = 30, start=None, end=None, max_days: int = 365):
    """Preset [as_of-N, as_of] (N+1 days); custom ranges swapped if
    reversed and clamped to ``max_days``."""
    if start is None:
        t = as_date(as_of)
        return t - dt.timedelta(days=days), t
    s, e = as_date(start), as_date(end)
    if s > e:
        s, e = e, s
    if (e - s).days > max_days:
        s = e - dt.timedelta(days=max_days)
    return s, e


def comparison_range(start, end, kind: str = "previous"):
    """previous = [start-1-len, start-1] with len=(end-start).days;
    'wow'/'mom'/'yoy' shift both ends by 7/30/365 days; 'none' -> None."""
    s, e = as_date(start), as_date(end)
    if kind == "none":
        return None
    if kind == "previous":
        pe = s - dt.timedelta(days=1)
        return pe - dt.timedelta(days=(e - s).days), pe
    off = dt.timedelta(days=COMPARE_OFFSETS[kind])
    return s - off, e - off


def in_range(c: str | Column, start, end) -> Column:
    """Inclusive date filter."""
    return col(c).between(F.lit(as_date(start)), F.lit(as_date(end)))


def since(c: str | Column, cutoff) -> Column:
    """Open-ended ``>= cutoff``."""
    return col(c) >= F.lit(as_date(cutoff))


def half_open(c: str | Column, start, end) -> Column:
    """``>= start AND < end``."""
    return (col(c) >= F.lit(as_date(start))) & (col(c) < F.lit(as_date(end)))


def filter_period(df: DataFrame, date_col: str, start, end) -> DataFrame:
    return df.where(in_range(date_col, start, end))


def tag_periods(df: DataFrame, date_col: str, cur: tuple, prev: tuple | None) -> DataFrame:
    """Add ``period`` in {'current','previous'}; rows outside both are dropped
    and a row inside both (overlapping windows) is emitted once per period.
    One scan feeds both periods; aggregate with ``groupBy(..., 'period')``."""
    tags = [F.when(in_range(date_col, *cur), F.lit("current"))]
    if prev is not None:
        tags.append(F.when(in_range(date_col, *prev), F.lit("previous")))
    lo = min(as_date(cur[0]), as_date(prev[0]) if prev else as_date(cur[0]))
    hi = max(as_date(cur[1]), as_date(prev[1]) if prev else as_date(cur[1]))
    return (
        df.where(in_range(date_col, lo, hi))
        .withColumn("period", F.explode(F.array_compact(F.array(*tags))))
    )


def date_validity(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Per entity, count of unparsable dates and inclusive day span."""
    from mkpulse.functions import to_day

    d = to_day(c)
    return df.groupBy(*by).agg(
        F.sum(F.when(d.isNull(), 1).otherwise(0)).alias("invalid_dates"),
        (F.datediff(F.max(d), F.min(d)) + 1).alias("days_between"),
    )
