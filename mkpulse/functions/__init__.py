"""Column-expression helpers (scalar functions F01-F14, N11/N12).

Everything here returns a ``pyspark.sql.Column`` built from JVM-side
functions, so callers stay inside whole-stage codegen. Nothing runs a
Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: str | Column, default=0) -> Column:
    """NULL -> default (``COALESCE(x, 0)``)."""
    return F.coalesce(col(c), F.lit(default))


def div(a: str | Column, b: str | Column) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of an ANSI divide-by-zero error."""
    return col(a) / F.nullif(col(b), F.lit(0))


def safe_divide(a: str | Column, b: str | Column, default: float = 0.0) -> Column:
    """ratio, ``default`` when either side is NULL or the divisor is 0."""
    return F.coalesce(div(a, b), F.lit(float(default)))


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round half away from zero in two steps.

    The first step (``digits + 3``) absorbs floating-point summation noise, so
    a value whose exact decimal form sits on a tie rounds the same way no
    matter in which order its parts were added.
    """
    return F.round(F.round(col(c), digits + 3), digits)


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """``(cur - prev) / prev * 100`` only when ``prev > 0``; else NULL."""
    p = col(prev)
    return F.when(p > 0, (col(cur) - p) / p * 100)


def pct_change_abs(cur: str | Column, prev: str | Column) -> Column:
    """``(cur - prev) / |prev| * 100``; NULL if prev is 0/NULL or cur NULL."""
    p = col(prev)
    return F.when((p != 0) & col(cur).isNotNull(), (col(cur) - p) / F.abs(p) * 100)


def safe_float(c: str | Column, default: float | None = 0.0) -> Column:
    """string/number -> double; NULL, NaN or unparsable -> default.

    Each helper references its input once: conditional branches are not
    covered by common-subexpression elimination, so nested helpers that
    repeat their argument would multiply the work."""
    x = F.nanvl(col(c).cast("string").try_cast(T.DoubleType()), F.lit(None).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def safe_int(c: str | Column, default: int | None = 0) -> Column:
    """like Python ``int(float(x))`` - '12.7' -> 12, '-3.9' -> -3
    (truncation toward zero; out-of-range -> default)."""
    x = safe_float(c, None).try_cast(T.LongType())
    return x if default is None else F.coalesce(x, F.lit(int(default)).cast("bigint"))


def to_day(c: str | Column) -> Column:
    """date from 'yyyyMMdd', 'yyyy-MM-dd', DATE or TIMESTAMP; junk -> NULL."""
    s = col(c).cast("string")
    return F.coalesce(
        F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd")),
        F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"),
    )


def clean_name(name: str) -> str:
    """every character outside ``[A-Za-z0-9_]`` becomes ``_``."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def clean_columns(df: DataFrame) -> DataFrame:
    """F06 over a whole schema (metadata-only projection)."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """recursively expand struct columns to ``parent<sep>child`` columns."""

    def walk(dtype: T.DataType, path: list[str]) -> list[Column]:
        if isinstance(dtype, T.StructType):
            out: list[Column] = []
            for f in dtype.fields:
                out += walk(f.dataType, path + [f.name])
            return out
        ref = F.col(".".join(f"`{p}`" for p in path))
        return [ref.alias(sep.join(path))]

    cols: list[Column] = []
    for f in df.schema.fields:
        cols += walk(f.dataType, [f.name])
    return df.select(*cols)


def truncate_tail(c: str | Column, max_len: int = 50, keep: int = 47) -> Column:
    """Longer than ``max_len`` -> '...' + last ``keep`` characters."""
    s = col(c)
    return F.when(F.length(s) > max_len, F.concat(F.lit("..."), F.substring(s, -keep, keep))).otherwise(s)


def truncate_head(c: str | Column, keep: int = 40) -> Column:
    """Longer than ``keep`` -> first ``keep`` characters + '...'."""
    s = col(c)
    return F.when(F.length(s) > keep, F.concat(F.substring(s, 1, keep), F.lit("..."))).otherwise(s)


def last_path_segment(c: str | Column, max_len: int = 40) -> Column:
    """Only the last '/' segment when the path is longer than ``max_len``."""
    s = col(c)
    return F.when(F.length(s) > max_len, F.element_at(F.split(s, "/"), -1)).otherwise(s)


def humanize(c: str | Column) -> Column:
    """'SEARCH_ADS' -> 'Search Ads'."""
    return F.initcap(F.regexp_replace(F.lower(col(c)), "_", " "))


def concat_key(*cols: str | Column, sep: str = " / ") -> Column:
    """NULL-propagating ``a || sep || b``."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(col(c))
    return F.concat(*parts)


def comma_join(arr: str | Column, sep: str = ",") -> Column:
    """array of strings -> one string (NULL array -> NULL)."""
    return F.array_join(col(arr), sep)


# fixed values: the action types read for app installs, in priority order
APP_INSTALL_TYPES = ("mobile_app_install", "omni_app_install", "app_install")


def _first_of_type(actions: str | Column, action_type: str) -> Column:
    """Value of the first entry of ``action_type`` (NULL if none). Uses the
    position in the extracted type array - no lambda, so it stays in
    generated code."""
    arr = col(actions)
    pos = F.array_position(arr["action_type"], F.lit(action_type))
    return F.get(arr, pos.cast("int") - 1)["value"]  # position 0 (absent) -> index -1 -> NULL


def action_count(actions: str | Column, types: str | Sequence[str]) -> Column:
    """First entry whose type is present (in priority order), truncated to
    a long; an entry present with 0 wins over later types; none -> 0."""
    types = [types] if isinstance(types, str) else list(types)
    raw = F.coalesce(*[_first_of_type(actions, t) for t in types])
    return nz(safe_int(raw, None), 0)


def action_value(actions: str | Column, types: str | Sequence[str]) -> Column:
    """Same lookup as :func:`action_count`, value as double (default 0)."""
    types = [types] if isinstance(types, str) else list(types)
    raw = F.coalesce(*[_first_of_type(actions, t) for t in types])
    return nz(safe_float(raw, None), 0.0)


def action_count_last(actions: str | Column, action_type: str) -> Column:
    """N11 variant of the account comparison: the LAST entry of exactly
    ``action_type`` wins (no alternative install types); none -> 0."""
    arr = F.reverse(col(actions))
    pos = F.array_position(arr["action_type"], F.lit(action_type))
    return nz(safe_int(F.get(arr, pos.cast("int") - 1)["value"], None), 0)


def cents_to_units(c: str | Column, numeric: bool = False) -> Column:
    """Budget in cents -> units, Python truthiness rule ``x/100 if x else None``:
    string column: NULL or '' -> NULL, '0' -> 0.0; numeric column: NULL or 0 -> NULL."""
    s = col(c)
    falsy = s.isNull() | (s == 0 if numeric else s.cast("string") == "")
    return F.when(falsy, F.lit(None).cast("double")).otherwise(safe_float(s, None) / 100)


def weekday_name(d: str | Column) -> Column:
    """English weekday name (Monday..Sunday)."""
    return F.date_format(col(d), "EEEE")


# fixed values: short labels of the known search-ads campaign types
CAMPAIGN_TYPE_LABELS = {
    "SEARCH": "Search", "PERFORMANCE_MAX": "PMax", "DISPLAY": "Display", "VIDEO": "Video", "SHOPPING": "Shopping", "SMART": "Smart",
    "LOCAL": "Local", "DISCOVERY": "Discovery", "DEMAND_GEN": "Demand Gen", "APP": "App", "HOTEL": "Hotel",
    "LOCAL_SERVICES": "Local Svc", "MULTI_CHANNEL": "Multi-Ch",
}


def campaign_type_label(c: str | Column) -> Column:
    """Short label of a known campaign type, else its words in title case; NULL or empty is ``Unknown``."""
    x = col(c)
    known = F.create_map(*[F.lit(v) for kv in CAMPAIGN_TYPE_LABELS.items() for v in kv])
    return F.when(x.isNull() | (x == ""), "Unknown").otherwise(F.coalesce(
        F.try_element_at(known, x), F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))))


def is_set(c: str | Column, placeholder: str = "(not set)") -> Column:
    """The dimension has a value that is not the source's placeholder."""
    x = col(c)
    return x.isNotNull() & (x != placeholder)


def optional_equals(c: str | Column, value) -> Column:
    """``c`` equals ``value``; no filter when ``value`` is None."""
    return F.lit(True) if value is None else col(c) == value
