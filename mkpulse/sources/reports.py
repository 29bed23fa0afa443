"""Row shaping of the landed platform reports.

Vendor API calls are not Spark work and are not rebuilt; what is kept is the
shaping of each report row into bronze columns. Every function takes the raw
landed DataFrame (read with a declared schema, see ``schemas``) and returns
the bronze projection: narrow ``select``s over nested fields, so the JSON /
Parquet reader only materialises the referenced leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.functions import APP_INSTALL_TYPES, action_count, action_value, cents_to_units, comma_join, nz, safe_float, safe_int


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Read landed report files with a declared schema."""
    r = spark.read.schema(schema)
    return r.json(path) if fmt == "json" else r.format(fmt).load(path)


#: What :func:`inspect_landed` adds to the landed columns.
RECORD, REASON, FILE = "_record", "_reason", "_file"


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of the fields that hold a single value (lists are one value)."""
    out: list[str] = []
    for f in schema.fields:
        path = prefix + f.name
        out += leaf_paths(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [path]
    return out


def inspect_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", required: Sequence[str] = ()) -> DataFrame:
    """Landed rows with their file (``_file``), the record as it stands
    (``_record``) and why it can not be used (``_reason``, NULL if it can).

    Reasons: ``malformed`` (the line is no record of the format), ``wrong
    type: <fields>`` (a value does not fit the declared type; the reader would
    make it NULL without a trace), ``missing: <fields>`` (a required field is
    absent or NULL). JSON is read line by line, blank lines are skipped;
    columnar formats hold typed values, so only ``required`` can fail there.
    """
    if fmt == "json":
        lines = spark.read.text(path).select(F.col("value").alias(RECORD), F.col("_metadata.file_path").alias(FILE)).where(F.trim(RECORD) != "")
        kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
        parsed = lines.withColumn("_r", F.from_json(RECORD, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        # values that the line has and the row lost
        lost = F.array_compact(F.array(*[F.when(F.col(f"_r.{p}").isNull() & F.get_json_object(RECORD, f"$.{p}").isNotNull(), F.lit(p)) for p in leaf_paths(schema)]))
        whole = F.try_parse_json(RECORD).isNotNull() & F.trim(RECORD).startswith("{")
        broken = F.when(F.col("_r._corrupt").isNotNull(), F.when(~whole, F.lit("malformed")).otherwise(
            F.concat(F.lit("wrong type: "), F.array_join(lost, ", "))))
        rows, at = parsed, "_r."
    else:
        rows = spark.read.schema(schema).format(fmt).load(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias(FILE), F.to_json(F.struct(*rows.columns)).alias(RECORD))
        broken, at = F.lit(None).cast("string"), ""
    missing = F.array_compact(F.array(*[F.when(F.col(at + p).isNull(), F.lit(p)) for p in required]).cast("array<string>"))
    absent = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return rows.select(*[F.col(f"{at}`{f.name}`").alias(f.name) for f in schema.fields], RECORD, F.coalesce(broken, absent).alias(REASON), FILE)


def accepted(inspected: DataFrame) -> DataFrame:
    """The usable rows, in the declared columns."""
    return inspected.where(F.col(REASON).isNull()).drop(RECORD, REASON, FILE)


def rejected(inspected: DataFrame) -> DataFrame:
    """The others: file, reason and the record as it stands."""
    return inspected.where(F.col(REASON).isNotNull()).select(F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(RECORD).alias("record"))


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejected records per file and reason."""
    return rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("records"))


def land(spark: SparkSession, path: str, schema: T.StructType, quarantine: str, batch: str, fmt: str = "json", required: Sequence[str] = ()) -> DataFrame:
    """The usable rows of a landed batch; its other records are put into the
    quarantine table, under the batch's name. Landing the batch again replaces
    what it left there, so a record that was mended disappears."""
    from mkpulse.sinks import write_partition

    found = inspect_landed(spark, path, schema, fmt, required)
    write_partition(rejected(found), quarantine, "batch", batch)
    return accepted(found)


def _has(df: DataFrame, path: str) -> bool:
    cur: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(cur, T.StructType) or part not in cur.fieldNames():
            return False
        cur = cur[part].dataType
    return True


# --------------------------------------------------------------------- S01-S10
def search_ads_rows(raw: DataFrame) -> DataFrame:
    """Flatten a nested search-ads report row. Only the parts present in
    the row schema produce columns. Money in micros -> units (0 when absent),
    conversion_rate = conversions / clicks (0 without clicks). Hour 0 is kept
    (the reference's truthiness test lost midnight)."""
    cols: list[Column] = []

    def add(path: str, name: str, expr: Column | None = None) -> None:
        if _has(raw, path):
            cols.append((expr if expr is not None else F.col(path)).alias(name))

    add("customer.id", "customer_id")
    add("customer.descriptive_name", "customer_name")
    add("campaign.id", "campaign_id")
    add("campaign.name", "campaign_name")
    add("campaign.status", "campaign_status")
    add("campaign.advertising_channel_type", "campaign_type")
    add("ad_group.id", "ad_group_id")
    add("ad_group.name", "ad_group_name")
    add("ad_group.status", "ad_group_status")
    add("ad_group.type", "ad_group_type")
    add("ad_group_ad.ad.id", "ad_id")
    add("ad_group_ad.status", "ad_status")
    add("ad_group_ad.ad.type", "ad_type")
    add("ad_group_criterion.criterion_id", "keyword_id")
    add("ad_group_criterion.keyword.text", "keyword_text")
    add("ad_group_criterion.keyword.match_type", "keyword_match_type")
    add("ad_group_criterion.status", "keyword_status")
    add("segments.date", "date")
    add("segments.device", "device")
    add("segments.ad_network_type", "ad_network_type")
    add("segments.click_type", "click_type")
    add("segments.conversion_action", "conversion_action")
    add("segments.conversion_action_name", "conversion_action_name")
    add("segments.hour", "hour")
    add("segments.day_of_week", "day_of_week")
    add("geographic_view.country_criterion_id", "country_criterion_id")
    add("geographic_view.location_type", "location_type")
    if _has(raw, "metrics"):
        m = "metrics."
        for f_ in ("impressions", "clicks", "cost_micros", "ctr", "conversions", "conversions_value", "all_conversions",
                   "all_conversions_value", "view_through_conversions", "interactions", "interaction_rate",
                   "engagement_rate", "search_impression_share", "top_impression_percentage",
                   "absolute_top_impression_percentage"):
            add(m + f_, f_)
        add(m + "cost_micros", "cost", F.coalesce(F.col(m + "cost_micros") / 1e6, F.lit(0.0)))
        add(m + "average_cpc", "average_cpc_micros")
        add(m + "average_cpc", "average_cpc", F.coalesce(F.col(m + "average_cpc") / 1e6, F.lit(0.0)))
        add(m + "average_cpm", "average_cpm_micros")
        add(m + "average_cpm", "average_cpm", F.coalesce(F.col(m + "average_cpm") / 1e6, F.lit(0.0)))
        if _has(raw, m + "clicks") and _has(raw, m + "conversions"):
            cols.append(F.coalesce(F.col(m + "conversions") / F.nullif(F.col(m + "clicks"), F.lit(0)), F.lit(0.0)).alias("conversion_rate"))
    return raw.select(*cols)


@dataclass(frozen=True)
class ReportSpec:
    """A search-ads report: the row part that must be present, extra filters."""

    name: str
    entity: str  # struct whose presence defines the report's rows
    table: str
    not_null: tuple[str, ...] = ()


# fixed values: the search-ads reports and their bronze tables
SEARCH_ADS_REPORTS = {
    "campaigns": ReportSpec("campaigns", "campaign", "gads_campaigns"),  # S02
    "ad_groups": ReportSpec("ad_groups", "ad_group", "gads_ad_groups"),  # S03
    "keywords": ReportSpec("keywords", "ad_group_criterion", "gads_keywords"),  # S04
    "ads": ReportSpec("ads", "ad_group_ad", "gads_ads"),  # S05
    "devices": ReportSpec("devices", "segments", "gads_devices", ("device",)),  # S06
    "geographic": ReportSpec("geographic", "geographic_view", "gads_geographic"),  # S07
    "hourly": ReportSpec("hourly", "segments", "gads_hourly", ("hour",)),  # S08
    "conversions": ReportSpec("conversions", "segments", "gads_conversions", ("conversion_action",)),  # S09
    "daily_summary": ReportSpec("daily_summary", "campaign", "gads_daily_summary"),  # S10
}


def search_ads_report(raw: DataFrame, spec: ReportSpec, start=None, end=None) -> DataFrame:
    """The report's rows (entity present, required segments not
    NULL), restricted to ``date BETWEEN start AND end``."""
    rows = search_ads_rows(raw.where(F.col(spec.entity).isNotNull()))
    for c in spec.not_null:
        rows = rows.where(F.col(c).isNotNull())
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(str(start)))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(str(end)))
    return rows


def account_daily_summary(summary: DataFrame) -> DataFrame:
    """S10 option: the 'daily summary' really holds one row per campaign; sum
    it to one row per date."""
    metrics = [c for c in ("impressions", "clicks", "cost_micros", "cost", "conversions", "conversions_value") if c in summary.columns]
    return summary.groupBy("date").agg(*[F.sum(c).alias(c) for c in metrics])


# --------------------------------------------------------------------- S11-S12
# fixed values: the search-console dimension sets (dataset name -> dimensions)
SEARCH_CONSOLE_SETS = {
    "gsc_queries": ("date", "query"),
    "gsc_pages": ("date", "page"),
    "gsc_countries": ("date", "country"),
    "gsc_devices": ("date", "device"),
    "gsc_search_appearance": ("date", "searchAppearance"),
    "gsc_query_page": ("query", "page"),
    "gsc_query_country": ("query", "country"),
    "gsc_query_device": ("query", "device"),
    "gsc_page_country": ("page", "country"),
    "gsc_page_device": ("page", "device"),
    "gsc_daily_totals": ("date",),
}


def search_console_rows(raw: DataFrame, dimensions: Sequence[str], dataset: str) -> DataFrame:
    """keys[i] -> dimension i (missing -> NULL), metrics default 0,
    ``_dataset`` tag. More than 3 dimensions is an error, as in the API."""
    if len(dimensions) > 3:
        raise ValueError("at most 3 dimensions per search-console request")
    return raw.select(
        F.lit(dataset).alias("_dataset"),
        *[F.get(F.col("keys"), i).alias(d) for i, d in enumerate(dimensions)],
        nz("clicks", 0).cast("bigint").alias("clicks"),
        nz("impressions", 0).cast("bigint").alias("impressions"),
        nz("ctr", 0.0).cast("double").alias("ctr"),
        nz("position", 0.0).cast("double").alias("position"),
    )


def search_console_batch(raw: DataFrame, sets=None) -> DataFrame:
    """S12 for a landing batch that mixes several dimension sets: each row
    carries its ``_dataset`` and positional ``keys``; every dimension of any
    set becomes a column (NULL for sets without it). One pass over the batch,
    whatever the number of sets."""
    sets = SEARCH_CONSOLE_SETS if sets is None else sets
    dims: list[str] = []
    for ds in sets.values():
        dims += [d for d in ds if d not in dims]
    cols = [F.col("_dataset")]
    for d in dims:
        e = None
        for name, ds in sets.items():
            if d in ds:
                hit = F.col("_dataset") == name
                v = F.get(F.col("keys"), ds.index(d))
                e = F.when(hit, v) if e is None else e.when(hit, v)
        cols.append(e.alias(d))
    return raw.select(
        *cols,
        nz("clicks", 0).cast("bigint").alias("clicks"),
        nz("impressions", 0).cast("bigint").alias("impressions"),
        nz("ctr", 0.0).cast("double").alias("ctr"),
        nz("position", 0.0).cast("double").alias("position"),
    )


# --------------------------------------------------------------------- S13-S14
@dataclass(frozen=True)
class WebReport:
    table: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]


# fixed values: the web-analytics report set (unified loader shape)
WEB_REPORTS = {
    "ga4_sessions": WebReport("ga4_sessions", ("date",), ("sessions", "totalUsers", "newUsers", "bounceRate")),
    "ga4_traffic_overview": WebReport("ga4_traffic_overview", ("date", "sessionSource", "sessionMedium", "sessionCampaignName"),
                                      ("sessions", "totalUsers", "newUsers", "bounceRate", "screenPageViews")),
    "ga4_page_performance": WebReport("ga4_page_performance", ("date", "pagePath", "pageTitle"),
                                      ("screenPageViews", "sessions", "bounceRate", "averageSessionDuration")),
    "ga4_geographic_data": WebReport("ga4_geographic_data", ("date", "country", "region", "city"),
                                     ("sessions", "totalUsers", "newUsers")),
    "ga4_technology_data": WebReport("ga4_technology_data", ("date", "deviceCategory", "operatingSystem", "browser"),
                                     ("sessions", "totalUsers", "screenPageViews")),
    "ga4_event_data": WebReport("ga4_event_data", ("date", "eventName"), ("eventCount", "totalUsers")),
}


def web_report_rows(raw: DataFrame, report: WebReport) -> DataFrame:
    """Positional dimension / metric values -> named string columns."""
    return raw.select(
        *[F.get(F.col("dimension_values"), i)["value"].alias(d) for i, d in enumerate(report.dimensions)],
        *[F.get(F.col("metric_values"), i)["value"].alias(m) for i, m in enumerate(report.metrics)],
    )


# --------------------------------------------------------------------- S15-S18
def _metric_int(c: str) -> Column:
    return safe_int(c, 0)


def _metric_float(c: str) -> Column:
    return safe_float(c, 0.0)


_BASE_METRICS_INT = ("impressions", "reach", "clicks", "unique_clicks")
_BASE_METRICS_FLOAT = ("spend", "ctr", "cpc", "cpm", "frequency", "cost_per_unique_click")


def _action_cols(raw: DataFrame) -> list[Column]:
    cols = [
        action_count("actions", "link_click").alias("link_clicks"),
        action_count("actions", "page_engagement").alias("page_engagement"),
        action_count("actions", "post_engagement").alias("post_engagement"),
        action_count("actions", APP_INSTALL_TYPES).alias("app_installs"),
        action_count("actions", "purchase").alias("purchases"),
        action_count("actions", "lead").alias("leads"),
        action_value("action_values", "purchase").alias("purchase_value"),
    ]
    for q in ("p25", "p50", "p75", "p100"):
        src = f"video_{q}_watched_actions"
        if src in raw.columns:
            cols.append(action_count(src, "video_view").alias(f"video_{q}"))
    return cols


def social_insights_rows(raw: DataFrame, level: str = "account", account_id: str | None = None) -> DataFrame:
    """Daily insights at account, campaign or ad-set level: numbers
    cast with defaults 0, actions parsed (N11 / N12)."""
    ids = {
        "account": [],
        "campaign": ["campaign_id", "campaign_name"],
        "adset": ["campaign_id", "campaign_name", "adset_id", "adset_name"],
        "ad": ["campaign_id", "campaign_name", "adset_id", "adset_name", "ad_id", "ad_name"],
    }[level]
    acct = F.lit(account_id) if account_id is not None else F.col("account_id")
    return raw.select(
        F.to_date("date_start").alias("date"),
        acct.alias("ad_account_id"),
        *[F.col(c) for c in ids],
        *[_metric_int(c).alias(c) for c in _BASE_METRICS_INT],
        *[_metric_float(c).alias(c) for c in _BASE_METRICS_FLOAT],
        *_action_cols(raw),
    )


def ad_insights_with_fallback(primary: DataFrame, per_ad: DataFrame, ads_meta: DataFrame) -> DataFrame:
    """Ad-level insights; when the primary request returned nothing, the
    per-ad insights joined to ad metadata (campaign / ad-set names blank).
    The 'primary is empty' gate is a NOT EXISTS subquery - no action on the
    driver, no join."""
    fb = per_ad.join(ads_meta.select(F.col("ad_id"), F.col("ad_name").alias("_meta_name"), "adset_id", "campaign_id"), "ad_id")
    fb = fb.withColumn("campaign_name", F.lit("")).withColumn("adset_name", F.lit(""))
    fb = fb.withColumn("ad_name", F.coalesce(F.col("_meta_name"), F.col("ad_name") if "ad_name" in per_ad.columns else F.lit(None))).drop("_meta_name")
    fb = fb.where(~primary.exists())
    return primary.unionByName(fb, allowMissingColumns=True)


# fixed values: the period breakdowns of social insights (dimension columns)
SOCIAL_BREAKDOWNS = {
    "meta_geographic": ("country",),
    "meta_devices": ("device_platform", "publisher_platform"),
    "meta_demographics": ("age", "gender"),
}


def social_breakdown_rows(raw: DataFrame, breakdown: str, account_id: str | None = None) -> DataFrame:
    """Period rows (not daily) per breakdown."""
    dims = SOCIAL_BREAKDOWNS[breakdown]
    acct = F.lit(account_id) if account_id is not None else F.col("account_id")
    cols = [
        F.to_date("date_start").alias("date_start"), F.to_date("date_stop").alias("date_stop"), acct.alias("ad_account_id"),
        *[F.col(d) for d in dims],
        *[_metric_int(c).alias(c) for c in ("impressions", "reach", "clicks")],
        *[_metric_float(c).alias(c) for c in ("spend", "ctr", "cpc", "cpm")],
        action_count("actions", APP_INSTALL_TYPES).alias("app_installs"),
        action_count("actions", "purchase").alias("purchases"),
    ]
    if breakdown == "meta_geographic":
        cols.append(action_value("action_values", "purchase").alias("purchase_value"))
    return raw.select(*cols)


# --------------------------------------------------------------------- S19
def social_campaigns(raw: DataFrame, account_id: str) -> DataFrame:
    """Campaign metadata, budgets cents -> units (truthiness rule)."""
    return raw.select(
        F.col("id").alias("campaign_id"), F.lit(account_id).alias("ad_account_id"), F.col("name").alias("campaign_name"),
        "status", "effective_status", "objective",
        cents_to_units("daily_budget").alias("daily_budget"), cents_to_units("lifetime_budget").alias("lifetime_budget"),
        cents_to_units("budget_remaining").alias("budget_remaining"), "created_time", "start_time", "stop_time",
    )


def social_adsets(raw: DataFrame, account_id: str) -> DataFrame:
    """Ad-set metadata; target countries comma-joined (NULL when none)."""
    countries = F.col("targeting.geo_locations.countries")
    return raw.select(
        F.col("id").alias("adset_id"), F.lit(account_id).alias("ad_account_id"), "campaign_id",
        F.col("name").alias("adset_name"), "status", "effective_status", "optimization_goal", "billing_event",
        "bid_strategy",
        cents_to_units("daily_budget").alias("daily_budget"), cents_to_units("lifetime_budget").alias("lifetime_budget"),
        cents_to_units("budget_remaining").alias("budget_remaining"),
        F.when(F.size(countries) > 0, comma_join(countries)).alias("target_countries"),
        "created_time", "start_time", "end_time",
    )


def social_ads(raw: DataFrame, account_id: str) -> DataFrame:
    """Ad metadata; creative id only when the creative is a struct."""
    return raw.select(
        F.col("id").alias("ad_id"), F.lit(account_id).alias("ad_account_id"), F.col("name").alias("ad_name"), "adset_id",
        "campaign_id", "status", "effective_status", F.col("creative.id").alias("creative_id"), "created_time",
    )


# --------------------------------------------------------------------- S20-S21
def profile_snapshot(raw: DataFrame, snapshot_date) -> DataFrame:
    """One row per user per snapshot date."""
    pm = "public_metrics."
    return raw.select(
        F.col("id").alias("user_id"), "username", "name", "description", "location", "verified", "verified_type",
        "created_at", *[F.col(pm + c).cast("int").alias(c) for c in ("followers_count", "following_count", "tweet_count", "listed_count")],
        "profile_image_url", F.lit(snapshot_date).cast("date").alias("snapshot_date"),
    )


def post_type(in_reply_to: Column, refs: Column) -> Column:
    """reply if in_reply_to is set (truthy), else quote if any reference is
    'quoted', else original."""
    quoted = F.coalesce(F.exists(refs, lambda r: r["type"] == "quoted"), F.lit(False))
    return F.when(in_reply_to.isNotNull() & (in_reply_to != 0), "reply").when(quoted, "quote").otherwise("original")


def posts(raw: DataFrame, user_id: str, username: str, start=None, end=None, max_results: int | None = None) -> DataFrame:
    """Posts with metrics and type; ``max_results`` caps the newest
    posts, like the API's page limit (a feature of the request)."""
    pm = "public_metrics."
    df = raw
    if start is not None:
        df = df.where(F.col("created_at") >= F.lit(str(start)).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("created_at") < F.lit(str(end)).cast("timestamp"))
    out = df.select(
        F.col("id").cast("string").alias("tweet_id"), F.lit(user_id).alias("user_id"), F.lit(username).alias("username"),
        "text", post_type(F.col("in_reply_to_user_id"), F.col("referenced_tweets")).alias("tweet_type"),
        F.col("created_at").cast("string").alias("created_at"), F.to_date("created_at").alias("created_date"),
        *[nz(pm + src, 0).cast("int").alias(dst) for src, dst in (
            ("impression_count", "impressions"), ("like_count", "likes"), ("retweet_count", "retweets"),
            ("reply_count", "replies"), ("quote_count", "quotes"), ("bookmark_count", "bookmarks"))],
        F.col("lang").alias("language"), "source", F.col("conversation_id").cast("string").alias("conversation_id"),
        F.col("in_reply_to_user_id").cast("string").alias("in_reply_to_user_id"),
    )
    if max_results is not None:
        out = out.orderBy(F.desc("created_at"), F.desc("tweet_id")).limit(max_results)
    return out
