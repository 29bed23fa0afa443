"""Registered queries: silver / gold / dimension views V01-V11 over bronze
tables derived from the driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse import sinks as K
from mkpulse.plans import adapters as ad
from mkpulse.plans import views as V
from mkpulse.plans.catalog import DS, R, register
from mkpulse.plans.refresh import refresh_facts
from mkpulse.streaming import run_folder

def _cid():
    return F.regexp_extract("campaign_name", r"#(\d+)", 1).cast("bigint")
_CID_SQL = "CAST(regexp_extract(campaign_name, '#(\\d+)', 1) AS BIGINT)"


class _Lazy(dict):
    """name -> builder; a table is only planned when a view asks for it."""

    def __getitem__(self, name):
        v = dict.__getitem__(self, name)
        if v is None:
            raise KeyError(name)
        return v()


def _gads(t, adgroups: bool = False):
    g = ad.ads(t).where(F.col("platform") == "google_ads")
    day = F.date_format("date_day", "yyyy-MM-dd").alias("date")
    if not adgroups:
        return g.groupBy(day, _cid().alias("campaign_id"), "campaign_name").agg(
            F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
            F.sum("cost_micros").alias("cost_micros"), F.sum("spend").alias("cost"), F.sum("conversions").alias("conversions"),
            F.sum("conversion_value").alias("conversions_value"))
    return g.groupBy(day, _cid().alias("campaign_id"), F.col("ad_group_name"),
                     F.regexp_extract("ad_group_name", r"/(\d+)$", 1).cast("bigint").alias("ad_group_id")).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend").alias("cost"),
        F.sum("conversions").alias("conversions"), F.sum("conversion_value").alias("conversions_value"))


def _meta(t, adsets: bool = False):
    m = ad.ads(t).where(F.col("platform") == "meta_ads")
    keys = [F.col("date_day").alias("date"), F.col("account_id").alias("ad_account_id"), _cid().cast("string").alias("campaign_id"),
            "campaign_name"]
    if adsets:
        keys += [F.col("ad_group_name").alias("adset_name"), F.regexp_extract("ad_group_name", r"/(\d+)$", 1).alias("adset_id")]
    return m.groupBy(*keys).agg(
        F.sum("impressions").alias("impressions"), F.sum("reach").alias("reach"), F.sum("clicks").alias("clicks"),
        F.sum("spend").alias("spend"), F.sum("app_installs").alias("app_installs"), F.sum("purchases").alias("purchases"),
        F.sum("conversion_value").alias("purchase_value"))


def _gads_keywords(t):
    g = ad.ads(t).where(F.col("platform") == "google_ads")
    return g.groupBy(F.date_format("date_day", "yyyy-MM-dd").alias("date"), _cid().alias("campaign_id"),
                     F.regexp_extract("ad_group_name", r"/(\d+)$", 1).cast("bigint").alias("ad_group_id"),
                     "keyword_id", "keyword_text", "keyword_match_type").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend").alias("cost"),
        F.sum("conversions").alias("conversions"))


def _meta_ads(t):
    m = ad.ads(t).where(F.col("platform") == "meta_ads")
    return m.groupBy(F.col("date_day").alias("date"), F.col("account_id").alias("ad_account_id"),
                     _cid().cast("string").alias("campaign_id"),
                     F.regexp_extract("ad_group_name", r"/(\d+)$", 1).alias("adset_id"),
                     F.col("keyword_id").cast("string").alias("ad_id"), F.col("keyword_text").alias("ad_name")).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend").alias("spend"))


def _hourly(t):
    h = ad.hourly(t)
    return h.select(F.date_format("date_day", "yyyy-MM-dd").alias("date"), F.col("campaign_name"),
                    F.regexp_extract("campaign_name", r"(\d+)", 1).cast("bigint").alias("campaign_id"),
                    F.col("hour").cast("double").alias("hour"), "impressions", "clicks", F.col("cost").alias("cost"),
                    "conversions")


def _gsc_daily(t):
    return ad.organic_daily(t).select(F.lit("daily").alias("_dataset"), F.date_format("date_day", "yyyy-MM-dd").alias("date"),
                                      "clicks", "impressions", "ctr", "position")


def bronze(t, metadata: bool = False) -> _Lazy:
    """Bronze tables shaped like the landed platform tables, at their grain;
    each is only planned when a view asks for it."""
    return _Lazy({
        "gads_campaigns": lambda: _gads(t),
        "gads_ad_groups": lambda: _gads(t, adgroups=True),
        "gads_hourly": lambda: _hourly(t),
        "gads_keywords": lambda: _gads_keywords(t),
        "meta_ad_insights": lambda: _meta_ads(t),
        "meta_campaign_insights": lambda: _meta(t),
        "meta_adset_insights": lambda: _meta(t, adsets=True),
        "ga4_sessions": lambda: ad.web_sessions_raw(t),
        "gsc_daily_totals": lambda: _gsc_daily(t),
        "ga4_traffic_overview": lambda: _ga4_traffic(t),
        "gsc_queries": lambda: _gsc_set(t, "query"),
        "gsc_pages": lambda: _gsc_set(t, "page"),
        "meta_demographics": lambda: _meta_demographics(t),
    } | ({"meta_campaigns": lambda: _meta_campaigns(t)} if metadata else {}))


def _ga4_traffic(t):
    return ad.web_traffic(t).select(
        F.date_format("date_day", "yyyyMMdd").alias("date"), "sessionSource", "sessionMedium", F.lit("c1").alias("sessionCampaignName"),
        *[F.col(c).cast("string").alias(c) for c in ("sessions", "totalUsers")], F.lit("0").alias("newUsers"), F.lit("0.25").alias("bounceRate"),
        F.lit("bad").alias("screenPageViews"))


def _gsc_set(t, dim):
    return ad.organic(t).select(F.date_format("date_day", "yyyy-MM-dd").alias("date"), dim, "clicks", "impressions", "ctr", "position")


def _meta_demographics(t):
    b = ad.social_breakdowns(t)
    return b.select(F.col("date_start").cast("string").alias("date_start"), F.lit("act_1").alias("ad_account_id"), "age", "gender",
                    "impressions", "clicks", "spend")


def _meta_campaigns(t):
    """Metadata of the even brands and of one campaign that never ran."""
    n = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    some = t.part.select(n.alias("n")).distinct().where(F.col("n") % 2 == 0).union(t.region.select(F.lit(999).alias("n")).distinct())
    return some.select(F.col("n").cast("string").alias("campaign_id"), F.lit("act_1").alias("ad_account_id"),
                       F.concat(F.lit("Meta "), F.col("n").cast("string")).alias("campaign_name"),
                       F.when(F.col("n") % 4 == 0, "PAUSED").otherwise("ACTIVE").alias("status"), (F.col("n") * 1.5).alias("daily_budget"))


class _Views:
    def __init__(self, t, metadata=False):
        self.t, self.metadata = t, metadata

    def __getitem__(self, name):
        views, report = V.build_views(bronze(self.t, self.metadata), only=[name])
        if name not in views:
            raise KeyError(f"view {name} not built: {report}")
        return views[name]


def _views(t):
    return _Views(t)


_GADS_B = f"""gads_b AS (SELECT strftime(date_day, '%Y-%m-%d') AS date, {_CID_SQL} AS campaign_id, campaign_name,
  SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(cost_micros) AS cost_micros, SUM(spend) AS cost,
  SUM(conversions) AS conversions, SUM(conversion_value) AS conversions_value
  FROM ads WHERE platform = 'google_ads' GROUP BY 1, 2, 3)"""
_META_B = f"""meta_b AS (SELECT date_day AS date, account_id AS ad_account_id, CAST({_CID_SQL} AS VARCHAR) AS campaign_id,
  campaign_name, SUM(impressions) AS impressions, SUM(reach) AS reach, SUM(clicks) AS clicks, SUM(spend) AS spend,
  SUM(app_installs) AS app_installs, SUM(purchases) AS purchases, SUM(conversion_value) AS purchase_value
  FROM ads WHERE platform = 'meta_ads' GROUP BY 1, 2, 3, 4)"""
_PAID_SQL = f"""paid AS (
  SELECT CAST(date AS DATE) AS date_day, 'google_ads' AS platform, CAST(NULL AS VARCHAR) AS account_id,
    CAST(campaign_id AS VARCHAR) AS campaign_id, campaign_name, cost AS spend, clicks, impressions, conversions,
    CAST(NULL AS BIGINT) AS app_installs, conversions_value AS conversion_value FROM gads_b
  UNION ALL
  SELECT date, 'meta_ads', ad_account_id, campaign_id, campaign_name, spend, clicks, impressions,
    CAST(purchases AS DOUBLE), app_installs, purchase_value FROM meta_b)"""


@register("v01_web_silver", f"""
SELECT date, {DS("CAST(strptime(date, '%Y%m%d') AS DATE)")} AS date_day, CAST(sessions AS BIGINT) AS sessions,
  CAST(totalUsers AS BIGINT) AS totalUsers, CAST(newUsers AS BIGINT) AS newUsers, {R('CAST(bounceRate AS DOUBLE)')} AS bounceRate,
  'ga4' AS platform FROM web_sessions_raw""", ["web_sessions_raw"])
def v01(t):
    return _views(t)["ga4_sessions_v"]


@register("v02_search_console_silver", f"""
SELECT 'daily' AS _dataset, strftime(date_day, '%Y-%m-%d') AS date, clicks, impressions, {R('ctr')} AS ctr,
  {R('position')} AS position, {DS('date_day')} AS date_day, 'gsc' AS platform, {R('position')} AS avg_position
FROM organic_daily""", ["organic_daily"])
def v02(t):
    return _views(t)["gsc_daily_totals_v"]


@register("v03_social_silver", f"""
WITH {_META_B}
SELECT {DS('date')} AS date, ad_account_id AS account_id, campaign_id, campaign_name, CAST(impressions AS BIGINT) AS impressions,
  CAST(reach AS BIGINT) AS reach, CAST(clicks AS BIGINT) AS clicks, {R('spend')} AS spend, CAST(app_installs AS BIGINT) AS app_installs,
  CAST(purchases AS BIGINT) AS purchases, {R('purchase_value')} AS revenue, {DS('date')} AS date_day, 'meta_ads' AS platform
FROM meta_b""", ["ads"])
def v03(t):
    return _views(t)["meta_campaign_insights_v"]


@register("v04_hourly_silver", f"""
SELECT strftime(date_day, '%Y-%m-%d') AS date, campaign_name, CAST(regexp_extract(campaign_name, '(\\d+)', 1) AS BIGINT) AS campaign_id,
  hour, impressions, clicks, {R('cost')} AS cost, {R('conversions')} AS conversions, {DS('date_day')} AS date_day,
  'google_ads' AS platform, hour AS hour_of_day
FROM hourly""", ["hourly"])
def v04(t):
    return _views(t)["gads_hourly_v"]


@register("v05_fact_paid_daily", f"""
WITH {_GADS_B}, {_META_B}, {_PAID_SQL}
SELECT {DS('date_day')} AS date_day, platform, account_id, campaign_id, campaign_name, {R('spend')} AS spend,
  CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions, {R('conversions')} AS conversions,
  CAST(app_installs AS DOUBLE) AS app_installs, {R('conversion_value')} AS conversion_value FROM paid""", ["ads"])
def v05(t):
    return _views(t)["fact_paid_daily"].withColumn("app_installs", F.col("app_installs").cast("double"))


@register("v06_fact_paid_adgroup_daily", f"""
WITH g AS (SELECT date_day, {_CID_SQL} AS campaign_id, ad_group_name, CAST(regexp_extract(ad_group_name, '/(\\d+)$', 1) AS BIGINT) AS ad_group_id,
    SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS cost, SUM(conversions) AS conversions,
    SUM(conversion_value) AS conversions_value FROM ads WHERE platform = 'google_ads' GROUP BY 1, 2, 3, 4),
m AS (SELECT date_day, {_CID_SQL} AS campaign_id, ad_group_name, regexp_extract(ad_group_name, '/(\\d+)$', 1) AS ad_group_id,
    SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS spend, SUM(purchases) AS purchases,
    SUM(app_installs) AS app_installs, SUM(conversion_value) AS revenue FROM ads WHERE platform = 'meta_ads'
    GROUP BY date_day, account_id, 2, 3, 4)
SELECT {DS('date_day')} AS date_day, 'google_ads' AS platform, CAST(campaign_id AS VARCHAR) AS campaign_id,
  CAST(ad_group_id AS VARCHAR) AS ad_group_id, ad_group_name, {R('cost')} AS spend, CAST(clicks AS BIGINT) AS clicks,
  CAST(impressions AS BIGINT) AS impressions, {R('conversions')} AS conversions, CAST(NULL AS DOUBLE) AS app_installs,
  {R('conversions_value')} AS conversion_value FROM g
UNION ALL
SELECT {DS('date_day')}, 'meta_ads', CAST(campaign_id AS VARCHAR), ad_group_id, ad_group_name, {R('spend')},
  CAST(clicks AS BIGINT), CAST(impressions AS BIGINT), {R('CAST(purchases AS DOUBLE)')}, CAST(app_installs AS DOUBLE),
  {R('revenue')} FROM m""", ["ads"])
def v06(t):
    return _views(t)["fact_paid_adgroup_daily"].withColumn("app_installs", F.col("app_installs").cast("double"))


@register("v07_fact_organic_daily", f"""
SELECT {DS('date_day')} AS date_day, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(ctr)')} AS ctr, {R('AVG(position)')} AS position FROM organic_daily GROUP BY date_day""", ["organic_daily"])
def v07(t):
    return _views(t)["fact_organic_daily"]


@register("v08_fact_web_daily", f"""
SELECT {DS("CAST(strptime(date, '%Y%m%d') AS DATE)")} AS date_day, CAST(sessions AS BIGINT) AS sessions,
  CAST(totalUsers AS BIGINT) AS users, CAST(newUsers AS BIGINT) AS new_users, {R('CAST(bounceRate AS DOUBLE)')} AS bounce_rate
FROM web_sessions_raw""", ["web_sessions_raw"])
def v08(t):
    return _views(t)["fact_web_daily"]


@register("v09_dim_campaign", f"""
WITH {_GADS_B}, {_META_B}, {_PAID_SQL}
SELECT platform, campaign_id, campaign_name FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY platform, campaign_id ORDER BY date_day DESC NULLS LAST, campaign_name DESC NULLS LAST) AS rn
  FROM paid) WHERE rn = 1""", ["ads"])
def v09(t):
    return _views(t)["dim_campaign"]


@register("v10_platform_totals", f"""
WITH {_GADS_B}, {_META_B}, {_PAID_SQL}
SELECT platform, {R('SUM(spend)')} AS total_spend, CAST(SUM(clicks) AS BIGINT) AS total_clicks,
  CAST(SUM(impressions) AS BIGINT) AS total_impressions,
  {R('SUM(COALESCE(conversions, 0) + COALESCE(app_installs, 0))')} AS total_conversions,
  {DS('MIN(date_day)')} AS first_date, {DS('MAX(date_day)')} AS last_date FROM paid GROUP BY platform""", ["ads"])
def v10(t):
    return _views(t)["summary_platform_totals"]



def _dim_sql(src: str, keys: list[str], attrs: list[str]) -> str:
    order = ", ".join(["date DESC NULLS LAST"] + [f"{a} DESC NULLS LAST" for a in attrs])
    return f"""
SELECT {', '.join(keys + attrs)} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn FROM {src}) WHERE rn = 1"""


_GADS_AG = f"""gads_ag AS (SELECT strftime(date_day, '%Y-%m-%d') AS date, {_CID_SQL} AS campaign_id, ad_group_name,
  CAST(regexp_extract(ad_group_name, '/(\\d+)$', 1) AS BIGINT) AS ad_group_id
  FROM ads WHERE platform = 'google_ads' GROUP BY 1, 2, 3, 4)"""
_META_AS = f"""meta_as AS (SELECT date_day AS date, account_id, CAST({_CID_SQL} AS VARCHAR) AS campaign_id,
  ad_group_name, regexp_extract(ad_group_name, '/(\\d+)$', 1) AS ad_group_id
  FROM ads WHERE platform = 'meta_ads' GROUP BY 1, 2, 3, 4, 5)"""


@register("v09_dim_gads_campaign", f"WITH {_GADS_B}" + _dim_sql("gads_b", ["campaign_id"], ["campaign_name"]), ["ads"])
def v09a(t):
    return _views(t)["dim_gads_campaign"]


@register("v09_dim_gads_ad_group", f"WITH {_GADS_AG}" + _dim_sql("gads_ag", ["campaign_id", "ad_group_id"], ["ad_group_name"]),
          ["ads"])
def v09b(t):
    return _views(t)["dim_gads_ad_group"]


@register("v09_dim_meta_campaign", f"WITH {_META_B}, mb AS (SELECT *, ad_account_id AS account_id FROM meta_b)"
          + _dim_sql("mb", ["campaign_id"], ["campaign_name", "account_id"]), ["ads"])
def v09c(t):
    return _views(t)["dim_meta_campaign"]


@register("v09_dim_meta_adset", f"WITH {_META_AS}" + _dim_sql("meta_as", ["ad_group_id"], ["ad_group_name", "campaign_id", "account_id"]),
          ["ads"])
def v09d(t):
    return _views(t)["dim_meta_adset"]


@register("v09_dim_gads_keyword", f"""
WITH kw AS (SELECT strftime(date_day, '%Y-%m-%d') AS date, {_CID_SQL} AS campaign_id,
  CAST(regexp_extract(ad_group_name, '/(\\d+)$', 1) AS BIGINT) AS ad_group_id, keyword_id, keyword_text, keyword_match_type
  FROM ads WHERE platform = 'google_ads' GROUP BY 1, 2, 3, 4, 5, 6)"""
          + _dim_sql("kw", ["campaign_id", "ad_group_id", "keyword_id"], ["keyword_text", "keyword_match_type"]), ["ads"])
def v09e(t):
    return _views(t)["dim_gads_keyword"]


@register("v09_dim_meta_ad", f"""
WITH ma AS (SELECT date_day AS date, account_id, CAST({_CID_SQL} AS VARCHAR) AS campaign_id,
  regexp_extract(ad_group_name, '/(\\d+)$', 1) AS ad_group_id, CAST(keyword_id AS VARCHAR) AS ad_id, keyword_text AS ad_name
  FROM ads WHERE platform = 'meta_ads' GROUP BY 1, 2, 3, 4, 5, 6)"""
          + _dim_sql("ma", ["ad_id"], ["ad_name", "ad_group_id", "campaign_id", "account_id"]), ["ads"])
def v09f(t):
    return _views(t)["dim_meta_ad"]


@register("v09_dim_meta_campaign_metadata", f"""
WITH {_META_B}, mb AS (SELECT *, ad_account_id AS account_id FROM meta_b), ins AS ({_dim_sql("mb", ["campaign_id"], ["campaign_name", "account_id"])}),
n AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS n FROM part),
md AS (SELECT n FROM n WHERE n % 2 = 0 UNION SELECT 999)
SELECT CAST(n AS VARCHAR) AS campaign_id, 'Meta ' || CAST(n AS VARCHAR) AS campaign_name, 'act_1' AS account_id,
  CASE WHEN n % 4 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, {R('n * 1.5')} AS daily_budget FROM md
UNION ALL SELECT campaign_id, campaign_name, account_id, NULL, NULL FROM ins
WHERE campaign_id NOT IN (SELECT CAST(n AS VARCHAR) FROM md)""", ["ads"])
def v09_metadata(t):
    return _Views(t, metadata=True)["dim_meta_campaign"]


@register("v01_demographics_silver", f"""
SELECT CAST(date_start AS VARCHAR) AS date_start, 'act_1' AS account_id, age, gender, impressions, clicks, {R('spend')} AS spend,
  {DS('date_start')} AS date_day, 'meta_ads' AS platform FROM social_breakdowns""", ["social_breakdowns"])
def v01_demographics(t):
    return _views(t)["meta_demographics_v"]


@register("v02_pages_silver", f"""
SELECT strftime(date_day, '%Y-%m-%d') AS date, page, clicks, impressions, {R('ctr')} AS ctr, {R('position')} AS position,
  {DS('date_day')} AS date_day, 'gsc' AS platform, {R('position')} AS avg_position FROM organic""", ["organic"])
def v02_pages(t):
    return _views(t)["gsc_pages_v"]


@register("v07_fact_organic_queries", f"""
SELECT {DS('date_day')} AS date_day, query, clicks, impressions, {R('ctr')} AS ctr, {R('position')} AS position, {R('position')} AS avg_position
FROM organic""", ["organic"])
def v07_queries(t):
    return _views(t)["fact_organic_queries"]


@register("v08_fact_web_traffic", f"""
SELECT {DS('date_day')} AS date_day, sessionSource AS source, sessionMedium AS medium, 'c1' AS campaign, CAST(sessions AS BIGINT) AS sessions,
  CAST(totalUsers AS BIGINT) AS users, CAST(0 AS BIGINT) AS new_users, CAST(0.25 AS DOUBLE) AS bounce_rate FROM web_traffic""", ["web_traffic"])
def v08_traffic(t):
    return _views(t)["fact_web_traffic"].drop("page_views")


@register("v11_refreshed_fact", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS date_day, COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT {DS('date_day')} AS date_day, CASE WHEN date_day = (SELECT max(date_day) FROM d) THEN 2 * sessions ELSE sessions END AS sessions, users,
  date_day = (SELECT max(date_day) FROM d) AS rewritten FROM d""")
def v11_refreshed(t):
    """The gold fact is built from all days of its bronze table; the last day lands again, doubled, and only that day is rewritten."""
    base = run_folder(t.spark, "v11")
    raw = t.events.groupBy(F.to_date("ts").alias("date_day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))

    def landed(times):
        return raw.select(F.date_format("date_day", "yyyyMMdd").alias("date"), (F.col("n") * times).cast("string").alias("sessions"),
                          F.col("u").cast("string").alias("totalUsers"), F.lit("0").alias("newUsers"), F.lit("0.5").alias("bounceRate"), "date_day")

    bronze = {"ga4_sessions": base + "/ga4_sessions"}
    K.load(landed(1), bronze["ga4_sessions"], ["date_day"], lifetime=True, partition_col="date_day")
    refresh_facts(t.spark, bronze, base + "/gold")
    K.load(landed(2).where(F.col("date_day") == raw.select(F.max("date_day")).scalar()), bronze["ga4_sessions"], ["date_day"], lifetime=False,
           partition_col="date_day")
    days = [d.split("=", 1)[1] for d in refresh_facts(t.spark, bronze, base + "/gold")["fact_web_daily"]]
    fact = t.spark.read.parquet(base + "/gold/fact_web_daily")
    return fact.select("date_day", "sessions", "users", F.col("date_day").cast("string").isin(days).alias("rewritten"))


@register("v11_view_report", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"view\", '{s}' AS status, CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS fact_rows" for n, s in (
        ("gads_campaigns_v", "created"), ("meta_campaign_insights_v", "created"), ("fact_paid_daily", "created"), ("dim_campaign", "created"),
        ("summary_platform_totals", "created"))))
def v11_report(t):
    """The views that paid totals need, in dependency order; one row of the fact per order."""
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 9).alias("campaign_id"),
                        F.lit("c").alias("campaign_name"), F.lit(1).cast("long").alias("impressions"), F.lit(1).cast("long").alias("clicks"),
                        F.col("o_totalprice").alias("cost"), F.lit(1.0).alias("conversions"), F.lit(0.0).alias("conversions_value"), "o_custkey")
    meta = o.where(F.col("o_custkey") % 2 == 0).select(
        "date", F.lit("a").alias("ad_account_id"), F.col("campaign_id").cast("string").alias("campaign_id"), "campaign_name", "impressions", "clicks",
        F.col("impressions").alias("reach"), F.col("cost").alias("spend"), F.lit(1).cast("long").alias("app_installs"),
        F.lit(1).cast("long").alias("purchases"), F.lit(1.0).alias("purchase_value"))
    tables = {"gads_campaigns": o.where(F.col("o_custkey") % 2 == 1).drop("o_custkey"), "meta_campaign_insights": meta}
    views, report = V.build_views(tables, only=["summary_platform_totals", "dim_campaign"])
    rows = t.spark.createDataFrame([(n, s) for n, s, _ in report], "view string, status string")
    return rows.withColumn("fact_rows", views["fact_paid_daily"].agg(F.count(F.lit(1)).alias("n")).scalar())
