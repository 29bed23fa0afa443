"""Registered queries: report shaping S01-S23 over raw records derived from
the driver tables.

Each query first builds the nested raw record a platform would land (structs,
positional arrays, action lists, string-typed numbers) from driver rows, then
runs the library's shaping function on it. The oracle computes the expected
bronze columns straight from the driver rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register
from mkpulse.sources import reports as S
from mkpulse.sources import schemas as SC
from mkpulse.sources.catalog import execute_query, preview
from mkpulse.streaming import run_folder

_DEV = ad.DEVICES


def _pick(expr: Column, labels) -> Column:
    return ad._pick(expr, labels)


# ----------------------------------------------------------------- search ads
def _raw_search_ads(t):
    li = t.lineitem.where(F.col("l_linestatus") == "F")
    p = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    clicks = F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint")
    conv = F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)
    micros = F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.round(F.col("l_extendedprice") * 1000)).cast("bigint")
    ln = F.col("l_linenumber")
    return j.select(
        F.struct(
            F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint").alias("id"),
            F.col("p_brand").alias("name"),
            F.when(F.col("p_size") % 2 == 0, "ENABLED").otherwise("PAUSED").alias("status"),
            F.upper("p_type").alias("advertising_channel_type"),
        ).alias("campaign"),
        F.when(ln != 6, F.struct(F.col("p_size").cast("bigint").alias("id"),
                                 F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("name"))).alias("ad_group"),
        F.when(ln <= 4, F.struct(
            F.when(ln % 2 == 0, "REMOVED").otherwise("ENABLED").alias("status"),
            F.struct(F.col("l_orderkey").alias("id"), F.lit("RESPONSIVE_SEARCH_AD").alias("type")).alias("ad"),
        )).alias("ad_group_ad"),
        F.when(ln != 5, F.struct(
            F.col("p_partkey").alias("criterion_id"),
            F.struct(F.col("p_name").alias("text"), _pick(F.when(F.col("l_returnflag") == "A", 0).when(
                F.col("l_returnflag") == "N", 1).otherwise(2), ("EXACT", "PHRASE", "BROAD")).alias("match_type")).alias("keyword"),
        )).alias("ad_group_criterion"),
        F.when(ln % 2 == 1, F.struct(
            (F.col("l_suppkey") % 30 + 2000).alias("country_criterion_id"), F.lit("LOCATION_OF_PRESENCE").alias("location_type"),
        )).alias("geographic_view"),
        F.struct(
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
            F.when(ln != 4, _pick(F.col("l_linenumber") % 3, _DEV)).alias("device"),
            F.when(F.col("l_discount") >= 0.02, F.lit("purchase")).alias("conversion_action"),
            (F.col("l_orderkey") % 24).cast("int").alias("hour"),
        ).alias("segments"),
        F.struct(
            (F.col("l_quantity").cast("bigint") * 20).alias("impressions"),
            clicks.alias("clicks"),
            micros.alias("cost_micros"),
            (F.col("l_extendedprice") * 1000 / F.col("l_quantity")).alias("average_cpc"),
            conv.alias("conversions"),
            (conv * F.col("l_extendedprice") / 100).alias("conversions_value"),
        ).alias("metrics"),
    )


_S01_COLS = f"""CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS campaign_id, p_brand AS campaign_name,
  CASE WHEN p_size % 2 = 0 THEN 'ENABLED' ELSE 'PAUSED' END AS campaign_status, upper(p_type) AS campaign_type,
  CASE WHEN l_linenumber <> 6 THEN CAST(p_size AS BIGINT) END AS ad_group_id,
  CASE WHEN l_linenumber <> 6 THEN p_brand || '/' || CAST(p_size AS VARCHAR) END AS ad_group_name,
  CASE WHEN l_linenumber <= 4 THEN l_orderkey END AS ad_id,
  CASE WHEN l_linenumber > 4 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'REMOVED' ELSE 'ENABLED' END AS ad_status,
  CASE WHEN l_linenumber <= 4 THEN 'RESPONSIVE_SEARCH_AD' END AS ad_type,
  CASE WHEN l_linenumber <> 5 THEN p_partkey END AS keyword_id, CASE WHEN l_linenumber <> 5 THEN p_name END AS keyword_text,
  CASE WHEN l_linenumber = 5 THEN NULL WHEN l_returnflag = 'A' THEN 'EXACT' WHEN l_returnflag = 'N' THEN 'PHRASE' ELSE 'BROAD' END
    AS keyword_match_type,
  strftime(l_shipdate, '%Y-%m-%d') AS date,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'MOBILE' WHEN l_linenumber % 3 = 1 THEN 'DESKTOP' ELSE 'TABLET' END
    AS device,
  CASE WHEN l_discount >= 0.02 THEN 'purchase' END AS conversion_action,
  CAST(l_orderkey % 24 AS INTEGER) AS hour,
  CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 30 + 2000 END AS country_criterion_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 'LOCATION_OF_PRESENCE' END AS location_type,
  CAST(l_quantity AS BIGINT) * 20 AS impressions,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS clicks,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(ROUND(l_extendedprice * 1000) AS BIGINT) END AS cost_micros,
  CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS conversions,
  CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE * l_extendedprice / 100 AS conversions_value,
  l_extendedprice * 1000 / l_quantity AS average_cpc_micros, l_linenumber AS _ln"""


def _s01_sql(where: str = "TRUE") -> str:
    return f"""
WITH r AS (SELECT {_S01_COLS} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')
SELECT campaign_id, campaign_name, campaign_status, campaign_type, CAST(ad_group_id AS DOUBLE) AS ad_group_id, ad_group_name,
  CAST(ad_id AS DOUBLE) AS ad_id, ad_status, ad_type, CAST(keyword_id AS DOUBLE) AS keyword_id, keyword_text, keyword_match_type,
  date, device, conversion_action, hour, CAST(country_criterion_id AS DOUBLE) AS country_criterion_id, location_type,
  impressions, clicks, CAST(cost_micros AS DOUBLE) AS cost_micros, {R('conversions')} AS conversions,
  {R('conversions_value')} AS conversions_value,
  {R('COALESCE(cost_micros / 1e6, 0.0)')} AS cost, {R('average_cpc_micros')} AS average_cpc_micros,
  {R('COALESCE(average_cpc_micros / 1e6, 0.0)')} AS average_cpc,
  {R('COALESCE(conversions / NULLIF(clicks, 0), 0.0)')} AS conversion_rate
FROM r WHERE {where}"""


_S01_SQL = _s01_sql()


_NULLABLE_LONGS = ("cost_micros", "ad_group_id", "ad_id", "keyword_id", "country_criterion_id")


def _micros_as_double(df):
    # nullable long columns (absent row parts, NULL cost_micros are fixture
    # edge rows) are compared as double: pandas holds integers with NULLs as floats
    return df.select(*[F.col(c).cast("double").alias(c) if c in _NULLABLE_LONGS else F.col(c) for c in df.columns])


@register("s01_search_ads_rows", _S01_SQL)
def s01(t):
    return _micros_as_double(S.search_ads_rows(_raw_search_ads(t)))


# One report each, selected by the row part it needs
_REPORT_WHERE = {
    "campaigns": "campaign_id IS NOT NULL", "ad_groups": "_ln <> 6", "keywords": "_ln <> 5", "ads": "_ln <= 4",
    "devices": "device IS NOT NULL", "geographic": "_ln % 2 = 1",
}


def _report_query(report: str, code: str):
    @register(f"{code}_{report}_report", _s01_sql(_REPORT_WHERE[report]))
    def q(t):
        return _micros_as_double(S.search_ads_report(_raw_search_ads(t), S.SEARCH_ADS_REPORTS[report]))

    return q


for _code, _rep in (("s02", "campaigns"), ("s03", "ad_groups"), ("s04", "keywords"), ("s05", "ads"), ("s06", "devices"),
                    ("s07", "geographic")):
    _report_query(_rep, _code)


@register("s08_hourly_report", _s01_sql("hour IS NOT NULL"))
def s08(t):
    return _micros_as_double(S.search_ads_report(_raw_search_ads(t), S.SEARCH_ADS_REPORTS["hourly"]))


@register("s09_conversion_report", _s01_sql("conversion_action IS NOT NULL"))
def s09(t):
    return _micros_as_double(S.search_ads_report(_raw_search_ads(t), S.SEARCH_ADS_REPORTS["conversions"]))


@register("s10_account_daily_summary", f"""
WITH r AS (SELECT {_S01_COLS} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')
SELECT date, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  CAST(SUM(cost_micros) AS DOUBLE) AS cost_micros, {R('SUM(COALESCE(cost_micros / 1e6, 0.0))')} AS cost,
  {R('SUM(conversions)')} AS conversions, {R('SUM(conversions_value)')} AS conversions_value
FROM r GROUP BY date""")
def s10(t):
    return _micros_as_double(S.account_daily_summary(S.search_ads_report(_raw_search_ads(t), S.SEARCH_ADS_REPORTS["daily_summary"])))


# ------------------------------------------------------------- search console
def _raw_search_console(t):
    o = ad.organic(t)
    keys = F.when(F.col("device") == "TABLET", F.array("query", "page")).otherwise(F.array("query", "page", "device"))
    return o.select(
        keys.alias("keys"),
        F.when(F.col("clicks") == 7, F.lit(None)).otherwise(F.col("clicks")).alias("clicks"),
        F.col("impressions"), F.col("ctr"),
        F.when(F.col("clicks") == 6, F.lit(None)).otherwise(F.col("position")).alias("position"),
    )


@register("s11_search_console_rows", f"""
SELECT 'gsc_query_page_device' AS _dataset, query, page, CASE WHEN device = 'TABLET' THEN NULL ELSE device END AS device,
  CASE WHEN clicks = 7 THEN 0 ELSE clicks END AS clicks, impressions, {R('COALESCE(ctr, 0.0)')} AS ctr,
  {R('CASE WHEN clicks = 6 THEN 0.0 ELSE position END')} AS position
FROM organic""", ["organic"])
def s11(t):
    return S.search_console_rows(_raw_search_console(t), ("query", "page", "device"), "gsc_query_page_device")


# --------------------------------------------------------------- web reports
def _raw_web_report(t):
    w = ad.web_traffic(t)
    v = lambda c: F.struct(c.cast("string").alias("value"))
    return w.select(
        F.array(v(F.date_format("date_day", "yyyyMMdd")), v(F.col("sessionSource")), v(F.col("sessionMedium")),
                v(F.col("sessionCampaignName"))).alias("dimension_values"),
        F.array(v(F.col("sessions")), v(F.col("totalUsers")), v(F.col("newUsers")), v(F.round("bounceRate", 4)),
                v(F.col("screenPageViews"))).alias("metric_values"),
    )


@register("s13_web_report_rows", """
SELECT strftime(date_day, '%Y%m%d') AS date, sessionSource, sessionMedium, sessionCampaignName,
  CAST(sessions AS VARCHAR) AS sessions, CAST(totalUsers AS VARCHAR) AS totalUsers, CAST(newUsers AS VARCHAR) AS newUsers,
  CAST(round(bounceRate, 4) AS VARCHAR) AS bounceRate, CAST(screenPageViews AS VARCHAR) AS screenPageViews
FROM web_traffic""", ["web_traffic"])
def s13(t):
    return S.web_report_rows(_raw_web_report(t), S.WEB_REPORTS["ga4_traffic_overview"])


# -------------------------------------------------------------- social ads
def _act(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("action_type"), value.cast("string").alias("value"))


def _raw_social(t):
    j = t.lineitem.select("l_tax", "l_discount", "l_returnflag", "l_extendedprice", "l_shipdate", "l_suppkey", "l_partkey",
                          "l_quantity")
    actions = F.array_compact(F.array(
        _act("link_click", F.col("l_quantity").cast("bigint")),
        F.when(F.col("l_tax") >= 0.05, _act("mobile_app_install", F.lit("1"))),
        F.when(F.col("l_returnflag") == "R", _act("omni_app_install", F.lit("2.9"))),
        F.when(F.col("l_tax") >= 0.02, _act("app_install", F.lit("3"))),
        F.when(F.col("l_discount") >= 0.05, _act("purchase", F.lit("1.0"))),
    ))
    values = F.when(F.col("l_discount") >= 0.05, F.array(_act("purchase", F.col("l_extendedprice") / 100)))
    return j.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_start"),
        F.concat(F.lit("act_"), (F.col("l_suppkey") % 4).cast("string")).alias("account_id"),
        (F.col("l_partkey") % 25).cast("string").alias("campaign_id"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 25).cast("string")).alias("campaign_name"),
        (F.col("l_suppkey") % 10).cast("string").alias("adset_id"),
        F.concat(F.lit("set"), (F.col("l_suppkey") % 10).cast("string")).alias("adset_name"),
        (F.col("l_quantity").cast("bigint") * 20).cast("string").alias("impressions"),
        F.lit(None).cast("string").alias("reach"),
        F.col("l_quantity").cast("bigint").cast("string").alias("clicks"),
        F.lit("").alias("unique_clicks"),
        (F.col("l_extendedprice") / 1000).cast("string").alias("spend"),
        *[F.lit(None).cast("string").alias(c) for c in ("ctr", "cpc", "cpm", "frequency", "cost_per_unique_click")],
        actions.alias("actions"),
        values.alias("action_values"),
    )


def _s15_sql(extra: str = "") -> str:
    return f"""
SELECT {DS('CAST(l_shipdate AS DATE)')} AS date, 'act_' || CAST(l_suppkey % 4 AS VARCHAR) AS ad_account_id,
  CAST(l_partkey % 25 AS VARCHAR) AS campaign_id, 'c' || CAST(l_partkey % 25 AS VARCHAR) AS campaign_name,{extra}
  CAST(l_quantity AS BIGINT) * 20 AS impressions, CAST(0 AS BIGINT) AS reach, CAST(l_quantity AS BIGINT) AS clicks,
  CAST(0 AS BIGINT) AS unique_clicks, {R('l_extendedprice / 1000')} AS spend, CAST(0 AS DOUBLE) AS ctr,
  CAST(0 AS DOUBLE) AS cpc, CAST(0 AS DOUBLE) AS cpm, CAST(0 AS DOUBLE) AS frequency, CAST(0 AS DOUBLE) AS cost_per_unique_click,
  CAST(l_quantity AS BIGINT) AS link_clicks, CAST(0 AS BIGINT) AS page_engagement, CAST(0 AS BIGINT) AS post_engagement,
  CAST(CASE WHEN l_tax >= 0.05 THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_tax >= 0.02 THEN 3 ELSE 0 END AS BIGINT) AS app_installs,
  CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS purchases, CAST(0 AS BIGINT) AS leads,
  {R('CASE WHEN l_discount >= 0.05 THEN l_extendedprice / 100 ELSE 0.0 END')} AS purchase_value
FROM lineitem"""


@register("s15_social_insights", _s15_sql())
def s15(t):
    return S.social_insights_rows(_raw_social(t), "campaign")


@register("s16_social_adset_insights", _s15_sql(
    " CAST(l_suppkey % 10 AS VARCHAR) AS adset_id, 'set' || CAST(l_suppkey % 10 AS VARCHAR) AS adset_name,"))
def s16(t):
    return S.social_insights_rows(_raw_social(t), "adset")


@register("n11_last_match_installs", """
SELECT 'act_' || CAST(l_suppkey % 4 AS VARCHAR) AS ad_account_id,
  CAST(SUM(CASE WHEN l_tax >= 0.02 THEN 3 ELSE 0 END) AS BIGINT) AS app_installs,
  CAST(SUM(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS purchases
FROM lineitem GROUP BY 1""")
def n11_last(t):
    from mkpulse.functions import action_count_last

    raw = _raw_social(t)
    rows = raw.select(F.col("account_id").alias("ad_account_id"),
                      action_count_last("actions", "app_install").alias("app_installs"),
                      action_count_last("actions", "purchase").alias("purchases"))
    return rows.groupBy("ad_account_id").agg(F.sum("app_installs").alias("app_installs"), F.sum("purchases").alias("purchases"))


def _raw_social_breakdown(t):
    b = ad.social_breakdowns(t)
    acts = F.array_compact(F.array(
        F.when(F.col("app_installs") > 0, _act("app_install", F.col("app_installs"))),
        F.when(F.col("purchases") > 0, _act("purchase", F.col("purchases"))),
    ))
    return b.select(
        F.col("date_start").cast("string").alias("date_start"), F.col("date_start").cast("string").alias("date_stop"),
        F.lit("act_1").alias("account_id"), "age", "gender", "country", "device_platform", "publisher_platform",
        F.col("impressions").cast("string").alias("impressions"), F.lit(None).cast("string").alias("reach"),
        F.col("clicks").cast("string").alias("clicks"), F.col("spend").cast("string").alias("spend"),
        *[F.lit(None).cast("string").alias(c) for c in ("ctr", "cpc", "cpm")],
        acts.alias("actions"),
        F.when(F.col("purchases") > 0, F.array(_act("purchase", F.col("purchases") * 2.5))).alias("action_values"),
    )


@register("s18_social_demographics", f"""
SELECT {DS('date_start')} AS date_start, {DS('date_start')} AS date_stop, 'act_1' AS ad_account_id, age, gender,
  impressions, CAST(0 AS BIGINT) AS reach, clicks, {R('spend')} AS spend, CAST(0 AS DOUBLE) AS ctr,
  CAST(0 AS DOUBLE) AS cpc, CAST(0 AS DOUBLE) AS cpm,
  app_installs, purchases
FROM social_breakdowns""", ["social_breakdowns"])
def s18(t):
    return S.social_breakdown_rows(_raw_social_breakdown(t), "meta_demographics")


@register("s18_social_devices", f"""
SELECT {DS('date_start')} AS date_start, {DS('date_start')} AS date_stop, 'act_1' AS ad_account_id, device_platform, publisher_platform,
  impressions, CAST(0 AS BIGINT) AS reach, clicks, {R('spend')} AS spend, CAST(0 AS DOUBLE) AS ctr,
  CAST(0 AS DOUBLE) AS cpc, CAST(0 AS DOUBLE) AS cpm, app_installs, purchases
FROM social_breakdowns""", ["social_breakdowns"])
def s18_devices(t):
    return S.social_breakdown_rows(_raw_social_breakdown(t), "meta_devices")


@register("s18_social_geographic", f"""
SELECT {DS('date_start')} AS date_start, {DS('date_start')} AS date_stop, 'act_1' AS ad_account_id, country,
  impressions, CAST(0 AS BIGINT) AS reach, clicks, {R('spend')} AS spend, CAST(0 AS DOUBLE) AS ctr,
  CAST(0 AS DOUBLE) AS cpc, CAST(0 AS DOUBLE) AS cpm, app_installs, purchases,
  {R('CASE WHEN purchases > 0 THEN purchases * 2.5 ELSE 0.0 END')} AS purchase_value
FROM social_breakdowns""", ["social_breakdowns"])
def s18_geographic(t):
    return S.social_breakdown_rows(_raw_social_breakdown(t), "meta_geographic")


def _raw_adsets(t):
    p = t.part
    k = F.col("p_partkey") % 4
    budget = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.lit("0")).otherwise(
        F.floor(F.col("p_retailprice") * 100).cast("bigint").cast("string"))
    countries = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(
        F.col("p_size") % 3 == 1, F.array(F.lit("US"))).otherwise(F.array(F.lit("US"), F.lit("CA")))
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("campaign_id"),
        F.lit("ACTIVE").alias("status"), F.lit("ACTIVE").alias("effective_status"), F.lit("APP_INSTALLS").alias("optimization_goal"),
        F.lit("IMPRESSIONS").alias("billing_event"), F.lit("LOWEST_COST").alias("bid_strategy"),
        budget.alias("daily_budget"), F.lit(None).cast("string").alias("lifetime_budget"), budget.alias("budget_remaining"),
        F.struct(F.struct(countries.alias("countries")).alias("geo_locations")).alias("targeting"),
        F.lit("2024-01-01T00:00:00").alias("created_time"), F.lit(None).cast("string").alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
    )


@register("s19_adsets", f"""
WITH b AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0.0
  ELSE CAST(floor(p_retailprice * 100) AS BIGINT) / 100.0 END AS budget FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS adset_id, 'act_9' AS ad_account_id, p_brand AS campaign_id, p_name AS adset_name,
  'ACTIVE' AS status, 'ACTIVE' AS effective_status, 'APP_INSTALLS' AS optimization_goal, 'IMPRESSIONS' AS billing_event,
  'LOWEST_COST' AS bid_strategy, {R('budget')} AS daily_budget, CAST(NULL AS DOUBLE) AS lifetime_budget,
  {R('budget')} AS budget_remaining,
  CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'US' ELSE 'US,CA' END AS target_countries,
  '2024-01-01T00:00:00' AS created_time, CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS end_time
FROM b""")
def s19(t):
    return S.social_adsets(_raw_adsets(t), "act_9")


def _raw_social_campaigns(t):
    p = t.part.select("p_brand", "p_size", "p_retailprice").groupBy("p_brand").agg(
        F.max("p_size").alias("sz"), F.max("p_retailprice").alias("price"))
    num = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    k = num % 4
    budget = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.lit("0")).otherwise(
        F.floor(F.col("price") * 100).cast("bigint").cast("string"))
    return p.select(
        num.cast("string").alias("id"), F.col("p_brand").alias("name"),
        F.when(num % 2 == 0, "ACTIVE").otherwise("PAUSED").alias("status"), F.lit("ACTIVE").alias("effective_status"),
        F.lit("APP_INSTALLS").alias("objective"), budget.alias("daily_budget"), F.lit(None).cast("string").alias("lifetime_budget"),
        budget.alias("budget_remaining"), F.lit("2024-01-01T00:00:00").alias("created_time"),
        F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("stop_time"),
    )


@register("s19_campaigns", f"""
WITH b AS (SELECT p_brand, MAX(p_retailprice) AS price FROM part GROUP BY p_brand),
c AS (SELECT *, CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS n FROM b),
d AS (SELECT *, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0.0
  ELSE CAST(floor(price * 100) AS BIGINT) / 100.0 END AS budget FROM c)
SELECT CAST(n AS VARCHAR) AS campaign_id, 'act_9' AS ad_account_id, p_brand AS campaign_name,
  CASE WHEN n % 2 = 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS status, 'ACTIVE' AS effective_status, 'APP_INSTALLS' AS objective,
  {R('budget')} AS daily_budget, CAST(NULL AS DOUBLE) AS lifetime_budget, {R('budget')} AS budget_remaining,
  '2024-01-01T00:00:00' AS created_time, CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS stop_time
FROM d""")
def s19c(t):
    return S.social_campaigns(_raw_social_campaigns(t), "act_9")


@register("s19_ads", """
SELECT CAST(p_partkey AS VARCHAR) AS ad_id, 'act_9' AS ad_account_id, p_name AS ad_name, CAST(p_size AS VARCHAR) AS adset_id,
  p_brand AS campaign_id, CASE WHEN p_partkey % 4 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, 'ACTIVE' AS effective_status,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'cr' || CAST(p_partkey AS VARCHAR) END AS creative_id,
  '2024-01-01T00:00:00' AS created_time
FROM part""")
def s19a(t):
    p = t.part
    raw = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("adset_id"),
        F.col("p_brand").alias("campaign_id"), F.when(F.col("p_partkey") % 4 == 0, "PAUSED").otherwise("ACTIVE").alias("status"),
        F.lit("ACTIVE").alias("effective_status"),
        F.when(F.col("p_partkey") % 5 != 0, F.struct(F.concat(F.lit("cr"), F.col("p_partkey").cast("string")).alias("id"))).alias("creative"),
        F.lit("2024-01-01T00:00:00").alias("created_time"),
    )
    return S.social_ads(raw, "act_9")


# -------------------------------------------------------------------- posts
def _raw_posts(t):
    c = t.conversations.select("conv_id", "turn", "role", "text")
    pid = F.col("conv_id") * 100 + F.col("turn")
    reply_to = F.when(F.col("role") == "assistant", F.col("conv_id") + 1).when(F.col("role") == "system", F.lit(0))
    refs = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.array(F.struct(
        F.when(F.col("turn") % 2 == 0, "quoted").otherwise("retweeted").alias("type"), (pid - 1).alias("id"))))
    ln = F.length("text").cast("bigint")
    return c.select(
        pid.alias("id"), "text", F.lit("fr").alias("lang"), F.lit("web").alias("source"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 24).cast("int"))).alias("created_at"),
        F.col("conv_id").alias("conversation_id"), reply_to.alias("in_reply_to_user_id"), refs.alias("referenced_tweets"),
        F.when(F.col("turn") == 3, F.lit(None)).otherwise(F.struct(
            ln.alias("impression_count"), (ln % 17).alias("like_count"), (F.col("turn") % 5).alias("retweet_count"),
            (F.col("conv_id") % 4).alias("reply_count"), (ln % 3).alias("quote_count"), (F.col("turn") % 2).alias("bookmark_count"),
        )).alias("public_metrics"),
    )


@register("s21_posts", f"""
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id, 'u1' AS user_id, 'acme' AS username, text,
  CASE WHEN role = 'assistant' THEN 'reply' WHEN role = 'user' AND turn > 0 AND turn % 2 = 0 THEN 'quote' ELSE 'original' END AS tweet_type,
  CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 24 AS BIGINT)) AS VARCHAR) AS created_at,
  {DS("CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 24 AS BIGINT)) AS DATE)")} AS created_date,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE length(text) END AS INTEGER) AS impressions,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE length(text) % 17 END AS INTEGER) AS likes,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE turn % 5 END AS INTEGER) AS retweets,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE conv_id % 4 END AS INTEGER) AS replies,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE length(text) % 3 END AS INTEGER) AS quotes,
  CAST(CASE WHEN turn = 3 THEN 0 ELSE turn % 2 END AS INTEGER) AS bookmarks,
  'fr' AS language, 'web' AS source, CAST(conv_id AS VARCHAR) AS conversation_id,
  CAST(CASE WHEN role = 'assistant' THEN conv_id + 1 WHEN role = 'system' THEN 0 END AS VARCHAR) AS in_reply_to_user_id
FROM conversations""")
def s21(t):
    return S.posts(_raw_posts(t), "u1", "acme")


# ----------------------------------------------------------------- ad hoc
@register("s22_adhoc_sql", f"""
SELECT l_returnflag, COUNT(*) AS n, {R('SUM(l_extendedprice)')} AS revenue FROM lineitem
WHERE l_quantity > 30 GROUP BY l_returnflag""")
def s22(t):
    return execute_query(
        t.spark,
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_extendedprice) AS revenue FROM {li} WHERE l_quantity > :q GROUP BY l_returnflag",
        {"q": 30}, li=t.lineitem,
    )


@register("s23_preview_newest", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {R('o_totalprice')} AS o_totalprice, {DS('o_orderdate')} AS o_orderdate,
  o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000""")
def s23(t):
    return preview(t.orders, 1000, ["o_orderdate", "o_orderkey"])


# ------------------------------------------------------------------- profiles
def _raw_profiles(t):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.lower(F.regexp_replace("c_name", "#", "_")).alias("username"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
        F.col("c_nationkey").cast("string").alias("location"), (F.col("c_acctbal") > 5000).alias("verified"),
        F.when(F.col("c_acctbal") > 5000, "blue").alias("verified_type"), F.lit("2020-01-01T00:00:00").alias("created_at"),
        F.lit(None).cast("string").alias("profile_image_url"),
        F.struct(F.floor("c_acctbal").cast("bigint").alias("followers_count"), F.col("c_nationkey").cast("bigint").alias("following_count"),
                 (F.col("c_custkey") % 100).alias("tweet_count"), F.lit(0).cast("bigint").alias("listed_count")).alias("public_metrics"),
    )


@register("s20_profile_snapshot", """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, lower(replace(c_name, '#', '_')) AS username, c_name AS name,
  c_mktsegment AS description, CAST(c_nationkey AS VARCHAR) AS location, c_acctbal > 5000 AS verified,
  CASE WHEN c_acctbal > 5000 THEN 'blue' END AS verified_type, '2020-01-01T00:00:00' AS created_at,
  CAST(floor(c_acctbal) AS INTEGER) AS followers_count, CAST(c_nationkey AS INTEGER) AS following_count,
  CAST(c_custkey % 100 AS INTEGER) AS tweet_count, 0 AS listed_count, CAST(NULL AS VARCHAR) AS profile_image_url,
  '2024-01-30' AS snapshot_date
FROM customer""")
def s20(t):
    return S.profile_snapshot(_raw_profiles(t), "2024-01-30")


# ------------------------------------------------------ search-console sets
# all S12 dimension sets; the organic fact has no country and no search
# appearance of its own, both are derived from its numbers
_GSC_SETS = tuple(S.SEARCH_CONSOLE_SETS)
_ALL_DIMS = ("date", "query", "page", "device", "country", "searchAppearance")
_DERIVED = {
    "country": (lambda: F.concat(F.lit("c"), (F.col("impressions") % 7).cast("string")), "'c' || CAST(impressions % 7 AS VARCHAR)"),
    "searchAppearance": (lambda: F.when(F.col("clicks") % 2 == 0, "RICHCARD").otherwise("VIDEO"),
                         "CASE WHEN clicks % 2 = 0 THEN 'RICHCARD' ELSE 'VIDEO' END"),
}


def _dim_expr(d: str):
    if d in _DERIVED:
        return _DERIVED[d][0]()
    return F.date_format("date_day", "yyyy-MM-dd") if d == "date" else F.col(d)


def _dim_sql(d: str) -> str:
    if d in _DERIVED:
        return _DERIVED[d][1]
    return "strftime(date_day, '%Y-%m-%d')" if d == "date" else d


@register("s12_search_console_sets", "\nUNION ALL\n".join(
    "SELECT '{ds}' AS _dataset, {cols}, clicks, impressions, {ctr} AS ctr, {pos} AS position FROM organic".format(
        ds=ds,
        cols=", ".join(
            (_dim_sql(d) if d in S.SEARCH_CONSOLE_SETS[ds] else "CAST(NULL AS VARCHAR)")
            + f" AS {d}" for d in _ALL_DIMS),
        ctr=R("COALESCE(ctr, 0.0)"), pos=R("COALESCE(position, 0.0)"))
    for ds in _GSC_SETS), ["organic"])
def s12(t):
    # one pass over the organic fact: each row is exploded into one raw
    # search-console row per dimension set, then shaped in one projection
    o = ad.organic(t)
    sets = {ds: S.SEARCH_CONSOLE_SETS[ds] for ds in _GSC_SETS}
    per_set = F.array(*[
        F.struct(F.lit(ds).alias("_dataset"), F.array(*[_dim_expr(d) for d in dims]).alias("keys"))
        for ds, dims in sets.items()
    ])
    raw = o.select(F.explode(per_set).alias("_r"), "clicks", "impressions", "ctr", "position").select(
        "_r._dataset", "_r.keys", "clicks", "impressions", "ctr", "position")
    return S.search_console_batch(raw, sets).select("_dataset", *_ALL_DIMS, "clicks", "impressions", "ctr", "position")


# ------------------------------------------------------ web report set
# report -> (adapter, dimension column of the adapter for each report dimension)
_WEB_SOURCES = {
    "ga4_sessions": ("web_sessions_raw", {"date": "date"}),
    "ga4_page_performance": ("web_pages", {"date": "date_day", "pagePath": "pagePath", "pageTitle": "pageTitle"}),
    "ga4_geographic_data": ("web_geo", {"date": "date_day", "country": "country", "region": "region", "city": "city"}),
    "ga4_technology_data": ("web_tech", {"date": "date_day", "deviceCategory": "deviceCategory",
                                         "operatingSystem": "operatingSystem", "browser": "browser"}),
    "ga4_event_data": ("web_events", {"date": "date_day", "eventName": "eventName"}),
}
_DOUBLE_METRICS = ("bounceRate", "averageSessionDuration")


def _web_value(src: str, col: str, spark_side: bool):
    if src == "date_day":
        return F.date_format("date_day", "yyyyMMdd") if spark_side else "strftime(date_day, '%Y%m%d')"
    if col in _DOUBLE_METRICS:  # two-step half-up rounding on both sides (ties are common for averages)
        from mkpulse.functions import rnd

        return rnd(F.col(col).cast("double"), 4).cast("string") if spark_side else f"CAST({R(col, 4)} AS VARCHAR)"
    return F.col(src).cast("string") if spark_side else f"CAST({src} AS VARCHAR)"


def _web_report_query(report: str):
    adapter, dims = _WEB_SOURCES[report]
    rep = S.WEB_REPORTS[report]
    sql_cols = [f"{_web_value(dims[d], d, False)} AS {d}" for d in rep.dimensions] + [
        f"{_web_value(m, m, False)} AS {m}" for m in rep.metrics]

    @register(f"s14_{report}", f"SELECT {', '.join(sql_cols)} FROM {adapter}", [adapter])
    def q(t):
        base = getattr(ad, adapter)(t)
        v = lambda c: F.struct(c.alias("value"))
        raw = base.select(
            F.array(*[v(_web_value(dims[d], d, True)) for d in rep.dimensions]).alias("dimension_values"),
            F.array(*[v(_web_value(m, m, True)) for m in rep.metrics]).alias("metric_values"),
        )
        return S.web_report_rows(raw, rep)

    return q


for _rep in _WEB_SOURCES:
    _web_report_query(_rep)


# ------------------------------------------------------------- rejected records
def _landed_lines(t):
    """Search-ads lines as text, some of them broken: cut off, a word for a number, without a campaign."""
    li = t.lineitem.where(F.col("l_linestatus") == "F")
    key, part = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey").cast("string")
    campaign = F.concat(F.lit('"campaign": {"id": '), part, F.lit("}, "))
    clicks = F.when(key % 29 == 0, F.lit('"many"')).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    line = F.concat(F.lit('{"ad_group": {"id": '), key.cast("string"), F.lit("}, "), F.when(key % 31 == 0, F.lit("")).otherwise(campaign),
                    F.lit('"metrics": {"clicks": '), clicks, F.lit("}}"))
    path = run_folder(t.spark, "landed-lines")
    li.select(F.when(key % 37 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return S.inspect_landed(t.spark, path, SC.SEARCH_ADS_RAW, required=["campaign.id"])


_LINE_KEY = "l_orderkey * 8 + l_linenumber"
_LINE_REASON = f"""CASE WHEN ({_LINE_KEY}) % 37 = 0 THEN 'malformed' WHEN ({_LINE_KEY}) % 29 = 0 THEN 'wrong type: metrics.clicks'
  WHEN ({_LINE_KEY}) % 31 = 0 THEN 'missing: campaign.id' END"""


@register("s01_rejected_records", f"""
SELECT CAST({_LINE_KEY} AS BIGINT) AS ad_group_id, {_LINE_REASON} AS reason FROM lineitem WHERE l_linestatus = 'F' AND {_LINE_REASON} IS NOT NULL""")
def s01_rejected(t):
    bad = S.rejected(_landed_lines(t))
    return bad.select(F.regexp_extract("record", r'"id": (\d+)', 1).cast("bigint").alias("ad_group_id"), "reason")


@register("s01_accepted_records", f"""
SELECT CAST({_LINE_KEY} AS BIGINT) AS ad_group_id, l_partkey AS campaign_id, CAST(l_quantity AS BIGINT) AS clicks
FROM lineitem WHERE l_linestatus = 'F' AND {_LINE_REASON} IS NULL""")
def s01_accepted(t):
    good = S.search_ads_rows(S.accepted(_landed_lines(t)))
    return good.select("ad_group_id", "campaign_id", "clicks")
