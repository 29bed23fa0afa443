"""Data-quality operators Q01-Q07.

Checks are aggregates: a grain check is one ``groupBy(keys).count()`` (a
shuffle on the keys, partial counts before it) followed by tiny aggregates
over the duplicate groups; null checks are one pass of conditional counts.
Samples of offending keys come from a bounded top-k, never from collecting
all duplicate groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mkpulse.operators.topk import top_k

# fixed values: declared grains of the bronze tables (keys for upsert and for
# validation; the search-console grains carry the dataset name)
GRAINS: dict[str, tuple[str, ...]] = {
    "ga4_sessions": ("date",),
    "ga4_traffic_overview": ("date", "sessionSource", "sessionMedium", "sessionCampaignName"),
    "ga4_page_performance": ("date", "pagePath"),
    "ga4_geographic_data": ("date", "country", "region", "city"),
    "ga4_technology_data": ("date", "deviceCategory", "operatingSystem", "browser"),
    "ga4_event_data": ("date", "eventName"),
    "gsc_queries": ("_dataset", "date", "query"),
    "gsc_pages": ("_dataset", "date", "page"),
    "gsc_countries": ("_dataset", "date", "country"),
    "gsc_devices": ("_dataset", "date", "device"),
    "gsc_search_appearance": ("date", "searchAppearance"),
    "gsc_query_page": ("_dataset", "query", "page"),
    "gsc_query_country": ("_dataset", "query", "country"),
    "gsc_query_device": ("_dataset", "query", "device"),
    "gsc_page_country": ("_dataset", "page", "country"),
    "gsc_page_device": ("_dataset", "page", "device"),
    "gsc_daily_totals": ("_dataset", "date"),
    "gads_campaigns": ("date", "campaign_id"),
    "gads_ad_groups": ("date", "campaign_id", "ad_group_id"),
    "gads_keywords": ("date", "campaign_id", "ad_group_id", "keyword_id"),
    "gads_ads": ("date", "campaign_id", "ad_group_id", "ad_id"),
    "gads_devices": ("date", "campaign_id", "device"),
    "gads_geographic": ("date", "campaign_id", "country_criterion_id"),
    "gads_hourly": ("date", "campaign_id", "hour"),
    "gads_conversions": ("date", "campaign_id", "conversion_action"),
    "gads_daily_summary": ("date", "campaign_id"),
    "meta_daily_account": ("date", "ad_account_id"),
    "meta_campaigns": ("campaign_id",),
    "meta_adsets": ("adset_id",),
    "meta_ads": ("ad_id",),
    "meta_campaign_insights": ("date", "ad_account_id", "campaign_id"),
    "meta_adset_insights": ("date", "ad_account_id", "adset_id"),
    "meta_ad_insights": ("date", "ad_account_id", "ad_id"),
    "meta_geographic": ("date_start", "ad_account_id", "country"),
    "meta_devices": ("date_start", "ad_account_id", "device_platform", "publisher_platform"),
    "meta_demographics": ("date_start", "ad_account_id", "age", "gender"),
    "twitter_profile": ("user_id", "snapshot_date"),
    "twitter_tweets": ("tweet_id",),
    "twitter_daily_metrics": ("date", "username"),
}


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def grain_summary(df: DataFrame, keys: Sequence[str], table: str = "") -> DataFrame:
    """Q01: duplicate groups and extra rows (Σ(count-1)); -1 when a key column
    is missing (the check cannot run)."""
    missing = [k for k in keys if k not in df.columns]
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame(
            [(table, ",".join(keys), -1, -1, f"missing key columns: {','.join(missing)}")],
            "table string, key_columns string, duplicate_groups long, duplicate_rows long, error string",
        )
    g = duplicate_groups(df, keys)
    return g.agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("duplicate_rows")
    ).select(
        F.lit(table).alias("table"), F.lit(",".join(keys)).alias("key_columns"), "duplicate_groups", "duplicate_rows",
        F.lit(None).cast("string").alias("error"),
    )


def grain_samples(df: DataFrame, keys: Sequence[str], limit: int = 5) -> DataFrame:
    """Q01: the ``limit`` most duplicated keys (count desc, keys asc)."""
    return top_k(duplicate_groups(df, keys), [F.desc("row_count"), *[F.asc_nulls_first(k) for k in keys]], limit)


def validate_all(tables: Mapping[str, DataFrame | None], grains: Mapping[str, Sequence[str]] = GRAINS) -> DataFrame:
    """Q02: Q01 for every table that has a declared grain; missing tables
    (None) are skipped. One union, one job."""
    out = None
    for name in sorted(tables):
        df = tables[name]
        if df is None or name not in grains:
            continue
        s = grain_summary(df, grains[name], name)
        out = s if out is None else out.unionByName(s)
    return out


def null_keys(df: DataFrame, keys: Sequence[str], table: str = "") -> DataFrame:
    """Q03: NULL count per key column in one pass; only columns with NULLs."""
    counts = df.agg(*[F.count(F.when(F.col(k).isNull(), 1)).alias(k) for k in keys])
    stacked = counts.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(k).alias("null_count")) for k in keys])).alias("s")
    ).select("s.*")
    return stacked.where(F.col("null_count") > 0).select(F.lit(table).alias("table"), "column", "null_count")


def dq_report(tables: Mapping[str, DataFrame], grains: Mapping[str, Sequence[str]] = GRAINS) -> DataFrame:
    """Q04: per table row count, grain check result and NULL key columns -
    each table's numbers come from ONE aggregate over its rows."""
    out = None
    for name in sorted(tables):
        df = tables[name]
        keys = list(grains.get(name, ()))
        if df is None:
            continue
        if keys and all(k in df.columns for k in keys):
            per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
                F.max(F.col(k).isNull().cast("int")).alias(f"_null_{i}") for i, k in enumerate(keys)])
            r = per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
                F.array_compact(F.array(*[
                    F.when(F.max(f"_null_{i}") == 1, F.lit(k)) for i, k in enumerate(keys)])).alias("_nk"),
            )
            r = r.select(
                F.lit(name).alias("table"), "row_count", (F.col("duplicate_rows") == 0).alias("grain_ok"),
                "duplicate_rows", F.array_join("_nk", ",").alias("null_key_columns"),
            )
        else:
            r = df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table"), "row_count", F.lit(None).cast("boolean").alias("grain_ok"),
                F.lit(None).cast("long").alias("duplicate_rows"), F.lit(None).cast("string").alias("null_key_columns"),
            )
        out = r if out is None else out.unionByName(r)
    return out


def duplicate_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q05: total rows, distinct key tuples (a NULL inside a tuple counts as a
    value, like a row comparison) and their difference."""
    g = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(F.struct(*keys)).alias("unique_keys"))
    return g.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_keys"))


def availability(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Q06: table present and non-empty, for every expected table, in ONE job
    (each present table contributes at most one row via ``limit(1)``)."""
    spark = None
    parts = []
    absent = []
    for name in sorted(tables):
        df = tables[name]
        if df is None:
            absent.append(name)
            continue
        spark = df.sparkSession
        parts.append(df.limit(1).agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit(name).alias("table"), F.lit(True).alias("present"), (F.col("_n") > 0).alias("has_data")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if absent and spark is not None:
        miss = spark.createDataFrame([(n, False, False) for n in absent], "table string, present boolean, has_data boolean")
        out = miss if out is None else out.unionByName(miss)
    return out


def validate_time_series(df: DataFrame, date_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Q07: required columns present (schema check, raises), date parsed from
    either format, rows without a date dropped, ordered by date."""
    from mkpulse.functions import to_day

    missing = [c for c in [date_col, *value_cols] if c not in df.columns]
    if missing:
        raise ValueError(f"time series is missing columns {missing}")
    return (
        df.select(to_day(date_col).alias(date_col), *[F.col(c).cast("double").alias(c) for c in value_cols])
        .where(F.col(date_col).isNotNull())
        .orderBy(date_col)
    )


class GrainViolation(Exception):
    """Raised by :func:`check_grains` when a declared grain is broken."""


def check_grains(tables: Mapping[str, DataFrame | None], grains: Mapping[str, Sequence[str]] = GRAINS) -> DataFrame:
    """Q02 as a gate (the validation step of view initialisation): run every
    grain check in one job and raise when any table has duplicates or could
    not be checked. The report has one row per table, so bringing it to the
    driver is bounded by the number of tables."""
    report = validate_all(tables, grains)
    if report is None:
        return report
    bad = [r for r in report.where(F.col("duplicate_rows") != 0).collect()]
    if bad:
        raise GrainViolation("; ".join(f"{r['table']}: {r['duplicate_rows']} extra rows" for r in bad))
    return report
