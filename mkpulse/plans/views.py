"""Silver / gold / dimension views V01-V11 as DataFrame functions.

The reference keeps these as SQL views whose DDL is not published; they are
rebuilt here from the columns the queries read. Each view is a pure function
``view(tables) -> DataFrame`` over the bronze tables; ``register_views``
creates temp views in dependency order and reports what it created.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mkpulse.functions import nz, safe_float, safe_int, to_day
from mkpulse.operators.windows import keep_latest

Tables = Mapping[str, DataFrame]


# ------------------------------------------------------------------- silver
def silver(df: DataFrame, date_col: str = "date", ints: Sequence[str] = (), floats: Sequence[str] = (),
           renames: Mapping[str, str] | None = None, platform: str | None = None) -> DataFrame:
    """``date`` -> ``date_day`` DATE (either format), numeric metrics cast
    (bad values -> NULL), renames, optional platform tag; other columns kept.
    One projection (no chain of ``withColumn``)."""
    renames = renames or {}
    cols = []
    for c in df.columns:
        if c == "date_day" and date_col in df.columns:
            continue  # a partition column of the bronze table: derived anew below
        e = F.col(c)
        if c in ints:
            e = safe_int(c, None)
        elif c in floats:
            e = safe_float(c, None)
        cols.append(e.alias(renames.get(c, c)))
    if date_col in df.columns:
        cols.append(to_day(date_col).alias("date_day"))
    if platform is not None:
        cols.append(F.lit(platform).alias("platform"))
    return df.select(*cols)


_GA4_INTS = ("sessions", "totalUsers", "newUsers", "screenPageViews", "eventCount")
_GA4_FLOATS = ("bounceRate", "averageSessionDuration")


def ga4_silver(df: DataFrame) -> DataFrame:
    """V01 for web-analytics bronze (all strings)."""
    return silver(df, "date", _GA4_INTS, _GA4_FLOATS, platform="ga4")


def gsc_silver(df: DataFrame) -> DataFrame:
    """Search-console silver; ``position`` is emitted both as itself and
    as ``avg_position`` (both names are read downstream)."""
    out = silver(df, "date", ("clicks", "impressions"), ("ctr", "position"), platform="gsc")
    return out.withColumn("avg_position", F.col("position"))


def gads_silver(df: DataFrame) -> DataFrame:
    """V01 for search-ads bronze."""
    return silver(df, "date", ("impressions", "clicks", "cost_micros"), ("cost", "ctr", "conversions", "conversions_value"),
                  platform="google_ads")


def meta_silver(df: DataFrame) -> DataFrame:
    """Social-ads silver: account / ad-set names standardised, purchase
    value as revenue."""
    ren = {"ad_account_id": "account_id", "adset_id": "ad_group_id", "adset_name": "ad_group_name", "purchase_value": "revenue"}
    return silver(df, "date", ("impressions", "reach", "clicks", "app_installs", "purchases"), ("spend", "purchase_value"),
                  renames=ren, platform="meta_ads")


def hourly_silver(df: DataFrame) -> DataFrame:
    """Hour as INT under both names read downstream."""
    out = gads_silver(df)
    return out.withColumn("hour", F.col("hour").cast("int")).withColumn("hour_of_day", F.col("hour"))


# --------------------------------------------------------------------- gold
PAID_COLS = ("date_day", "platform", "account_id", "campaign_id", "campaign_name", "spend", "clicks", "impressions",
             "conversions", "app_installs", "conversion_value")


def fact_paid_daily(gads_campaigns_v: DataFrame, meta_campaigns_v: DataFrame) -> DataFrame:
    """Search ads UNION ALL social ads at (day, platform, campaign)."""
    g = gads_campaigns_v.select(
        "date_day", "platform", F.lit(None).cast("string").alias("account_id"), F.col("campaign_id").cast("string").alias("campaign_id"),
        "campaign_name", F.col("cost").alias("spend"), "clicks", "impressions", "conversions",
        F.lit(None).cast("bigint").alias("app_installs"), F.col("conversions_value").alias("conversion_value"),
    )
    m = meta_campaigns_v.select(
        "date_day", "platform", "account_id", F.col("campaign_id").cast("string").alias("campaign_id"), "campaign_name", "spend",
        "clicks", "impressions", F.col("purchases").cast("double").alias("conversions"), "app_installs",
        F.col("revenue").alias("conversion_value"),
    )
    return g.unionByName(m)


def fact_paid_adgroup_daily(gads_ad_groups_v: DataFrame, meta_adsets_v: DataFrame) -> DataFrame:
    """Ad-group grain of V05."""
    g = gads_ad_groups_v.select(
        "date_day", "platform", F.col("campaign_id").cast("string").alias("campaign_id"),
        F.col("ad_group_id").cast("string").alias("ad_group_id"), "ad_group_name", F.col("cost").alias("spend"), "clicks",
        "impressions", "conversions", F.lit(None).cast("bigint").alias("app_installs"),
        F.col("conversions_value").alias("conversion_value"),
    )
    m = meta_adsets_v.select(
        "date_day", "platform", F.col("campaign_id").cast("string").alias("campaign_id"),
        F.col("ad_group_id").cast("string").alias("ad_group_id"), "ad_group_name", "spend", "clicks", "impressions",
        F.col("purchases").cast("double").alias("conversions"), "app_installs", F.col("revenue").alias("conversion_value"),
    )
    return g.unionByName(m)


def fact_organic_daily(gsc_daily_v: DataFrame) -> DataFrame:
    """Organic daily facts (one row per day)."""
    return gsc_daily_v.groupBy("date_day").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("ctr"), F.avg("position").alias("position"),
    )


def fact_organic_queries(gsc_queries_v: DataFrame) -> DataFrame:
    """Organic query facts."""
    return gsc_queries_v.select("date_day", "query", "clicks", "impressions", "ctr", "position", "avg_position")


def fact_web_daily(ga4_sessions_v: DataFrame) -> DataFrame:
    """Web daily facts."""
    return ga4_sessions_v.select(
        "date_day", F.col("sessions"), F.col("totalUsers").alias("users"), F.col("newUsers").alias("new_users"),
        F.col("bounceRate").alias("bounce_rate"),
    )


def fact_web_traffic(ga4_traffic_v: DataFrame) -> DataFrame:
    """Web traffic by source / medium / campaign."""
    return ga4_traffic_v.select(
        "date_day", F.col("sessionSource").alias("source"), F.col("sessionMedium").alias("medium"),
        F.col("sessionCampaignName").alias("campaign"), "sessions", F.col("totalUsers").alias("users"),
        F.col("newUsers").alias("new_users"), F.col("bounceRate").alias("bounce_rate"),
        F.col("screenPageViews").alias("page_views"),
    )


def dimension(df: DataFrame, keys: Sequence[str], attrs: Sequence[str], order_col: str = "date_day") -> DataFrame:
    """De-duplicated metadata - the latest row per id (ties: highest
    attribute values first, so the choice is deterministic). Attributes the
    input does not carry are skipped."""
    attrs = [a for a in attrs if a in df.columns and a not in keys]
    return keep_latest(df.select(*keys, *attrs, order_col), keys, order_col, list(attrs)).drop(order_col)


def social_dimension(insights: DataFrame, metadata: DataFrame | None, keys: Sequence[str], attrs: Sequence[str],
                     more: Sequence[str]) -> DataFrame:
    """V09 for social objects: the metadata row of an id (``attrs`` and
    ``more``, its status and budgets); ids that only insights know get their
    latest insight row. Without a metadata table: the insight rows alone."""
    known = dimension(insights, keys, attrs)
    if metadata is None:
        return known
    have = [c for c in (*attrs, *more) if c in metadata.columns]
    rows = metadata.select(*keys, *have).withColumn("_meta", F.lit(1)).unionByName(known.withColumn("_meta", F.lit(0)), allowMissingColumns=True)
    out = keep_latest(rows, keys, "_meta", [c for c in rows.columns if c not in (*keys, "_meta")]).drop("_meta")
    return out.select(*keys, *[c for c in (*attrs, *more) if c in out.columns])


def meta_metadata_silver(df: DataFrame) -> DataFrame:
    """V01 for social metadata: object names as in the insight views."""
    names = {"adset_id": "ad_group_id", "adset_name": "ad_group_name", "ad_account_id": "account_id"}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns], F.lit("meta_ads").alias("platform"))


def meta_period_silver(df: DataFrame) -> DataFrame:
    """V01 for social breakdowns: one row per period, day = its first day."""
    out = silver(df, "date_start", ("impressions", "reach", "clicks", "app_installs", "purchases"), ("spend", "ctr", "cpc", "cpm", "purchase_value"),
                 {"ad_account_id": "account_id", "purchase_value": "revenue"}, platform="meta_ads")
    return out


def summary_platform_totals(paid: DataFrame) -> DataFrame:
    """Totals per platform."""
    return paid.groupBy("platform").agg(
        F.sum("spend").alias("total_spend"), F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.sum(nz("conversions") + nz("app_installs")).alias("total_conversions"),
        F.min("date_day").alias("first_date"), F.max("date_day").alias("last_date"),
    )


# ------------------------------------------------------------- registration
ViewFn = Callable[..., DataFrame]

# dependency order: (view, inputs, function of the inputs); an input named "?x" may be missing
# fixed values: one silver view for each bronze table
_SILVER: dict[str, ViewFn] = {
    **dict.fromkeys(("ga4_page_performance", "ga4_geographic_data", "ga4_technology_data", "ga4_event_data"), ga4_silver),
    **dict.fromkeys(("gsc_pages", "gsc_countries", "gsc_devices", "gsc_search_appearance", "gsc_query_page", "gsc_query_country",
                     "gsc_query_device", "gsc_page_country", "gsc_page_device"), gsc_silver),
    **dict.fromkeys(("gads_ads", "gads_devices", "gads_geographic", "gads_conversions", "gads_daily_summary"), gads_silver),
    "meta_daily_account": meta_silver,
    **dict.fromkeys(("meta_geographic", "meta_devices", "meta_demographics"), meta_period_silver),
    **dict.fromkeys(("meta_campaigns", "meta_adsets", "meta_ads"), meta_metadata_silver),
}
VIEW_ORDER: list[tuple[str, tuple[str, ...], ViewFn]] = [
    *[(f"{table}_v", (table,), fn) for table, fn in _SILVER.items()],
    ("ga4_sessions_v", ("ga4_sessions",), ga4_silver),
    ("ga4_traffic_overview_v", ("ga4_traffic_overview",), ga4_silver),
    ("gsc_daily_totals_v", ("gsc_daily_totals",), gsc_silver),
    ("gsc_queries_v", ("gsc_queries",), gsc_silver),
    ("gads_campaigns_v", ("gads_campaigns",), gads_silver),
    ("gads_ad_groups_v", ("gads_ad_groups",), gads_silver),
    ("gads_hourly_v", ("gads_hourly",), hourly_silver),
    ("gads_keywords_v", ("gads_keywords",), gads_silver),
    ("meta_ad_insights_v", ("meta_ad_insights",), meta_silver),
    ("meta_campaign_insights_v", ("meta_campaign_insights",), meta_silver),
    ("meta_adset_insights_v", ("meta_adset_insights",), meta_silver),
    ("fact_paid_daily", ("gads_campaigns_v", "meta_campaign_insights_v"), fact_paid_daily),
    ("fact_paid_adgroup_daily", ("gads_ad_groups_v", "meta_adset_insights_v"), fact_paid_adgroup_daily),
    ("fact_organic_daily", ("gsc_daily_totals_v",), fact_organic_daily),
    ("fact_organic_queries", ("gsc_queries_v",), fact_organic_queries),
    ("fact_web_daily", ("ga4_sessions_v",), fact_web_daily),
    ("fact_web_traffic", ("ga4_traffic_overview_v",), fact_web_traffic),
    ("dim_campaign", ("fact_paid_daily",), lambda p: dimension(p, ["platform", "campaign_id"], ["campaign_name"])),
    # fixed values: the six metadata dimensions (keys, attributes)
    ("dim_gads_campaign", ("gads_campaigns_v",),
     lambda v: dimension(v, ["campaign_id"], ["campaign_name", "campaign_status", "campaign_type"])),
    ("dim_gads_ad_group", ("gads_ad_groups_v",),
     lambda v: dimension(v, ["campaign_id", "ad_group_id"], ["ad_group_name", "ad_group_status"])),
    ("dim_gads_keyword", ("gads_keywords_v",),
     lambda v: dimension(v, ["campaign_id", "ad_group_id", "keyword_id"], ["keyword_text", "keyword_match_type"])),
    ("dim_meta_campaign", ("meta_campaign_insights_v", "?meta_campaigns_v"),
     lambda v, m: social_dimension(v, m, ["campaign_id"], ["campaign_name", "account_id"],
                                   ["status", "effective_status", "objective", "daily_budget", "lifetime_budget"])),
    ("dim_meta_adset", ("meta_adset_insights_v", "?meta_adsets_v"),
     lambda v, m: social_dimension(v, m, ["ad_group_id"], ["ad_group_name", "campaign_id", "account_id"],
                                   ["status", "effective_status", "optimization_goal", "daily_budget", "lifetime_budget"])),
    ("dim_meta_ad", ("meta_ad_insights_v", "?meta_ads_v"),
     lambda v, m: social_dimension(v, m, ["ad_id"], ["ad_name", "ad_group_id", "campaign_id", "account_id"],
                                   ["status", "effective_status", "creative_id"])),
    ("summary_platform_totals", ("fact_paid_daily",), summary_platform_totals),
]
_DEPS = {name: deps for name, deps, _ in VIEW_ORDER}


def _needed(targets) -> set[str]:
    out: set[str] = set()
    todo = list(targets)
    while todo:
        n = todo.pop()
        if n in out:
            continue
        out.add(n)
        todo.extend(d.removeprefix("?") for d in _DEPS.get(n, ()))
    return out


def build_views(bronze: Tables, only=None) -> tuple[dict[str, DataFrame], list[tuple[str, str, str | None]]]:
    """Build the views (all, or ``only`` these and what they depend on)
    in dependency order; a view whose input is missing or fails to analyse
    is reported and skipped."""
    env: dict[str, DataFrame] = {}
    report: list[tuple[str, str, str | None]] = []
    need = _needed(only) if only else None

    def get(n: str) -> DataFrame | None:
        if n.startswith("?"):
            return env.get(n[1:])
        return env[n] if n in env else bronze[n]  # bronze may be a lazy mapping

    for name, deps, fn in VIEW_ORDER:
        if need is not None and name not in need:
            continue
        try:
            df = fn(*[get(d) for d in deps])
            df.schema  # analyse now, so a broken view fails here
            env[name] = df
            report.append((name, "created", None))
        except KeyError as e:
            report.append((name, "skipped", f"missing input {e}"))
        except Exception as e:  # noqa: BLE001 - reported, like the reference
            report.append((name, "failed", str(e)))
    return dict(env), report


def register_views(spark: SparkSession, bronze: Tables) -> DataFrame:
    """Create temp views in dependency order; returns the report."""
    views, report = build_views(bronze)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.createDataFrame(report, "view string, status string, error string")


def drop_views(spark: SparkSession) -> int:
    """Drop every view this module creates."""
    n = 0
    for name, _, _ in VIEW_ORDER:
        if spark.catalog.dropTempView(name):
            n += 1
    return n
