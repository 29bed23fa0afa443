"""Joins J01-J09.

Facts are aggregated to their join grain before any join (a day, a keyword,
a dimension value), so the join inputs are bounded by the key cardinality,
not by fact rows. No join carries a broadcast hint: the planner and AQE
broadcast a side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.functions import nz

By = Sequence[str]


def daily_trend(paid: DataFrame, web: DataFrame, organic: DataFrame, since=None, by: By = ()) -> DataFrame:
    """Paid spend/conversions, web sessions and organic clicks per day,
    FULL OUTER joined on the date (using-column join coalesces the key),
    gaps filled with 0."""
    keys = [*by, "date_day"]

    def cut(df: DataFrame) -> DataFrame:
        return df.where(F.col("date_day") >= F.lit(since)) if since is not None else df

    p = cut(paid).groupBy(*keys).agg(
        F.sum("spend").alias("paid_spend"), F.sum(nz("conversions") + nz("app_installs")).alias("conversions")
    )
    w = cut(web).groupBy(*keys).agg(F.sum("sessions").alias("sessions"))
    o = cut(organic).groupBy(*keys).agg(F.sum("clicks").alias("organic_clicks"))
    j = p.join(w, keys, "full").join(o, keys, "full")
    return j.select(
        *keys,
        nz("paid_spend", 0.0).alias("paid_spend"),
        nz("sessions").alias("sessions"),
        nz("conversions", 0.0).alias("conversions"),
        nz("organic_clicks").alias("organic_clicks"),
    )


def seo_ppc_overlap(organic: DataFrame, paid: DataFrame, by: By = (), min_organic_impressions: int = 100) -> DataFrame:
    """Inner join of organic and paid keyword aggregates on LOWER(text);
    organic kept when impressions > 100, paid when impressions > 0."""
    o = (
        organic.groupBy(*by, F.lower("query").alias("keyword"))
        .agg(
            F.sum("clicks").alias("organic_clicks"),
            F.sum("impressions").alias("organic_impressions"),
            F.avg("position").alias("avg_position"),
        )
        .where(F.col("organic_impressions") > min_organic_impressions)
    )
    p = (
        paid.groupBy(*by, F.lower("keyword_text").alias("keyword"))
        .agg(
            F.sum("clicks").alias("paid_clicks"),
            F.sum("spend").alias("paid_spend"),
            F.sum("conversions").alias("paid_conversions"),
            F.sum("impressions").alias("_pi"),
        )
        .where(F.col("_pi") > 0)
        .drop("_pi")
    )
    return o.join(p, [*by, "keyword"]).select(
        *by, "keyword", "organic_clicks", "avg_position", "paid_clicks", "paid_spend", "paid_conversions"
    )


def key_match(keys: Sequence[str], left: DataFrame, right: DataFrame, null_safe: bool = True) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k]
        cond = c if cond is None else cond & c
    return cond


def anti_by_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Target rows whose key is NOT in the batch (NULL = NULL when
    ``null_safe``). The batch side is reduced to distinct keys first."""
    bk = batch.select(*keys).dropDuplicates()
    return target.join(bk, key_match(keys, target, bk, null_safe), "left_anti")


def semi_by_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Target rows whose key IS in the batch (the rows an upsert replaces)."""
    bk = batch.select(*keys).dropDuplicates()
    return target.join(bk, key_match(keys, target, bk, null_safe), "left_semi")


def period_match(cur: DataFrame, prev: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows present in both periods, with ``<m>_prev`` and %-change."""
    p = prev.select(*keys, *[F.col(m).alias(f"{m}_prev") for m in metrics])
    j = cur.select(*keys, *metrics).join(p, list(keys))
    for m in metrics:
        pm = F.col(f"{m}_prev")
        j = j.withColumn(f"{m}_change", F.when(pm > 0, (F.col(m) - pm) / pm * 100))
    return j


def lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str, label: str, fallback: Column) -> DataFrame:
    """Dimension left join, label falls back to ``fallback``. No
    hint is given: the planner broadcasts only when the measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime) and
    falls back to a shuffle join beyond it."""
    j = df.join(dim, df[left_key] == dim[right_key], "left")
    return j.withColumn(label, F.coalesce(F.col(label), fallback)).drop(right_key) if right_key != left_key else j


def attach_scalars(df: DataFrame, scalars: DataFrame, by: By = ()) -> DataFrame:
    """Attach per-entity (or global) aggregates to every row. Global
    scalars (one row) become scalar subqueries - computed once, merged into a
    single aggregate by the optimizer and inlined as values, so no join at
    all; per-entity scalars join on the entity keys (NULL is an entity too)."""
    if by:
        own = scalars.select(*[F.col(c).alias(f"_by_{c}" if c in by else c) for c in scalars.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        return df.join(own, same, "left").drop(*[f"_by_{c}" for c in by])
    return df.select("*", *[scalars.select(c).scalar().alias(c) for c in scalars.columns])


def with_stats(df: DataFrame, aggs: Sequence[Column], by: By = ()) -> DataFrame:
    """Attach set-level statistics (``aggs``, aliased) to every row: one
    partially aggregated ``groupBy(by).agg`` plus a join - never a window over
    the whole set, so no single task receives all rows. Without ``by`` the
    statistics are one row and are broadcast."""
    return attach_scalars(df, df.groupBy(*by).agg(*aggs), by)


def keep_newest_semi(df: DataFrame, keys: Sequence[str], ts: str = "extracted_at") -> DataFrame:
    """Rows whose (key, ts) equals the key's MAX(ts); ties on the newest
    time all survive (unlike W01); rows with NULL time never match."""
    m = df.groupBy(*keys).agg(F.max(ts).alias("_mx"))
    cond = key_match(keys, df, m, True) & (df[ts] == m["_mx"])
    return df.join(m, cond, "left_semi")
