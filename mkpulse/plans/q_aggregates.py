"""Registered queries: aggregations A01-A50 over the adapter facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse.functions.periods import comparison_range, preset_range
from mkpulse.operators import aggregates as A
from mkpulse.operators.topk import top_k
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register

# as-of dates of the driver data (orders/lineitem end 2001, events January 2024)
LI_ASOF = "2001-10-31"
EV_ASOF = "2024-01-30"

CONV = "COALESCE(conversions, 0) + COALESCE(app_installs, 0)"


# ------------------------------------------------------------------ executive
@register("a01_paid_totals", f"""
SELECT {R('COALESCE(SUM(spend), 0)')} AS spend, CAST(COALESCE(SUM(clicks), 0) AS BIGINT) AS clicks,
  CAST(COALESCE(SUM(impressions), 0) AS BIGINT) AS impressions,
  {R(f'COALESCE(SUM({CONV}), 0)')} AS conversions,
  {R('COALESCE(SUM(COALESCE(conversion_value, 0)), 0)')} AS revenue
FROM ads_lean""", ["ads_lean"])
def a01(t):
    return A.paid_totals(ad.ads(t, dims=False))


@register("a02_web_totals", f"""
SELECT CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(users) AS BIGINT) AS users,
  CAST(SUM(new_users) AS BIGINT) AS new_users, {R('AVG(bounce_rate)')} AS bounce_rate
FROM web_daily""", ["web_daily"])
def a02(t):
    return A.web_totals(ad.web_daily(t))


@register("a03_organic_totals", f"""
SELECT CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(ctr)')} AS ctr, {R('AVG(position)')} AS position
FROM organic_daily""", ["organic_daily"])
def a03(t):
    return A.organic_totals(ad.organic_daily(t))


A04_SQL = f"""
SELECT platform AS channel, {R('SUM(spend)')} AS spend, CAST(SUM(clicks) AS BIGINT) AS clicks,
  CAST(SUM(impressions) AS BIGINT) AS impressions, {R(f'SUM({CONV})')} AS conversions,
  {R(f'CASE WHEN SUM({CONV}) > 0 THEN SUM(spend) / SUM({CONV}) END')} AS cpa
FROM ads_lean GROUP BY platform"""


@register("a04_channel_breakdown", A04_SQL, ["ads_lean"], headline=True)
def a04(t):
    return A.channel_breakdown(ad.ads(t, dims=False))


@register("a05_channel_table", f"""
SELECT platform AS channel, {R('SUM(spend)')} AS spend, CAST(SUM(clicks) AS BIGINT) AS clicks,
  CAST(SUM(impressions) AS BIGINT) AS impressions, {R(f'SUM({CONV})')} AS conversions,
  {R(f'CASE WHEN SUM({CONV}) > 0 THEN SUM(spend) / SUM({CONV}) END')} AS cpa
FROM ads_lean GROUP BY platform
UNION ALL
SELECT 'Organic Search', 0.0, CAST(SUM(clicks) AS BIGINT), CAST(SUM(impressions) AS BIGINT), 0.0, NULL
FROM organic_daily HAVING SUM(clicks) > 0""", ["ads_lean", "organic_daily"])
def a05(t):
    return A.channel_table(ad.ads(t, dims=False), ad.organic_daily(t))


@register("a06_daily_spend", f"""
SELECT {DS('date_day')} AS date_day, {R('SUM(spend)')} AS value FROM ads_lean GROUP BY date_day""", ["ads_lean"])
def a06(t):
    return A.daily_metric(ad.ads(t, dims=False), "spend")


@register("a06_daily_conversions", f"""
SELECT {DS('date_day')} AS date_day, {R(f'SUM({CONV})')} AS value FROM ads_lean GROUP BY date_day""", ["ads_lean"])
def a06c(t):
    return A.daily_metric(ad.ads(t, dims=False), A._conv())


@register("a06_daily_sessions", f"""
SELECT {DS('date_day')} AS date_day, CAST(SUM(sessions) AS BIGINT) AS value FROM web_daily GROUP BY date_day""", ["web_daily"])
def a06s(t):
    return A.daily_metric(ad.web_daily(t), "sessions")


@register("a06_daily_organic_clicks", f"""
SELECT {DS('date_day')} AS date_day, CAST(SUM(clicks) AS BIGINT) AS value FROM organic_daily GROUP BY date_day""",
          ["organic_daily"])
def a06o(t):
    return A.daily_metric(ad.organic_daily(t), "clicks")


_CUR = preset_range(LI_ASOF, 30)
_PREV = comparison_range(*_CUR)


def _between(c, rng):
    return f"{c} BETWEEN DATE '{rng[0]}' AND DATE '{rng[1]}'"


def _pc(cur, prev):
    return f"CASE WHEN {prev} > 0 THEN ({cur} - {prev}) / {prev} * 100 END"


_A07_INNER = f"""
SELECT
  COALESCE(SUM(CASE WHEN {_between('date_day', _CUR)} THEN spend END), 0) AS spend_cur,
  COALESCE(SUM(CASE WHEN {_between('date_day', _PREV)} THEN spend END), 0) AS spend_prev,
  COALESCE(SUM(CASE WHEN {_between('date_day', _CUR)} THEN {CONV} END), 0) AS conversions_cur,
  COALESCE(SUM(CASE WHEN {_between('date_day', _PREV)} THEN {CONV} END), 0) AS conversions_prev,
  CAST(COALESCE(SUM(CASE WHEN {_between('date_day', _CUR)} THEN clicks END), 0) AS BIGINT) AS clicks_cur,
  CAST(COALESCE(SUM(CASE WHEN {_between('date_day', _PREV)} THEN clicks END), 0) AS BIGINT) AS clicks_prev,
  COALESCE(SUM(CASE WHEN {_between('date_day', _CUR)} THEN COALESCE(conversion_value, 0) END), 0) AS revenue_cur,
  COALESCE(SUM(CASE WHEN {_between('date_day', _PREV)} THEN COALESCE(conversion_value, 0) END), 0) AS revenue_prev
FROM ads_lean WHERE date_day BETWEEN DATE '{_PREV[0]}' AND DATE '{_CUR[1]}'"""


@register("a07_kpi_tiles", f"""
WITH k AS ({_A07_INNER}),
k2 AS (SELECT *, CASE WHEN conversions_cur > 0 THEN spend_cur / conversions_cur END AS cpa_cur,
  CASE WHEN conversions_prev > 0 THEN spend_prev / conversions_prev END AS cpa_prev FROM k)
SELECT {R('spend_cur')} AS spend_cur, {R('spend_prev')} AS spend_prev,
  {R('conversions_cur')} AS conversions_cur, {R('conversions_prev')} AS conversions_prev,
  clicks_cur, clicks_prev, {R('revenue_cur')} AS revenue_cur, {R('revenue_prev')} AS revenue_prev,
  {R('cpa_cur')} AS cpa_cur, {R('cpa_prev')} AS cpa_prev,
  {R('CASE WHEN spend_cur > 0 THEN revenue_cur / spend_cur END')} AS roas,
  {R(_pc('spend_cur', 'spend_prev'))} AS spend_delta,
  {R(_pc('conversions_cur', 'conversions_prev'))} AS conversions_delta,
  {R(_pc('clicks_cur', 'clicks_prev'))} AS clicks_delta,
  {R(f"CASE WHEN cpa_cur IS NOT NULL AND cpa_prev IS NOT NULL THEN {_pc('cpa_cur', 'cpa_prev')} END")} AS cpa_delta
FROM k2""", ["ads_lean"])
def a07(t):
    return A.kpi_tiles(ad.ads(t, dims=False), _CUR, _PREV)


@register("a08_target_tracking", f"""
WITH tot AS (
  SELECT COALESCE(SUM(spend), 0) AS spend, CAST(COALESCE(SUM(clicks), 0) AS BIGINT) AS clicks,
    CAST(COALESCE(SUM(impressions), 0) AS BIGINT) AS impressions,
    COALESCE(SUM({CONV}), 0) AS conversions, COALESCE(SUM(COALESCE(conversion_value, 0)), 0) AS revenue
  FROM ads_lean),
x AS (SELECT *, LEAST(conversions / 1000.0, 1.5) AS cp,
  CASE WHEN conversions > 0 THEN spend / conversions ELSE 0.0 END AS cpa, spend / 10000.0 AS sp FROM tot)
SELECT {R('spend')} AS spend, clicks, impressions, {R('conversions')} AS conversions, {R('revenue')} AS revenue,
  {R('cp')} AS conversion_progress,
  CASE WHEN cp >= 1.0 THEN 'green' WHEN cp >= 0.7 THEN 'amber' ELSE 'red' END AS conversion_status,
  {R('cpa')} AS current_cpa,
  {R('CASE WHEN cpa <= 5.0 THEN 1.0 WHEN cpa <= 6.0 THEN 0.7 ELSE 0.3 END')} AS cpa_progress,
  CASE WHEN cpa <= 5.0 THEN 'green' WHEN cpa <= 6.0 THEN 'amber' ELSE 'red' END AS cpa_status,
  {R('sp')} AS budget_progress,
  CASE WHEN sp <= 0.9 THEN 'green' WHEN sp <= 1.0 THEN 'amber' ELSE 'red' END AS budget_status
FROM x""", ["ads_lean"])
def a08(t):
    return A.target_tracking(A.paid_totals(ad.ads(t, dims=False)))


# ---------------------------------------------------------------- web analytics
_WCUR = preset_range(EV_ASOF, 14)
_WPREV = comparison_range(*_WCUR)


@register("a09_web_summary", f"""
WITH s AS (SELECT *, CAST(strptime(date, '%Y%m%d') AS DATE) AS d FROM web_sessions_raw),
g AS (
  SELECT
    CAST(COALESCE(SUM(CASE WHEN {_between('d', _WCUR)} THEN CAST(sessions AS BIGINT) END), 0) AS BIGINT) AS sessions,
    CAST(COALESCE(SUM(CASE WHEN {_between('d', _WCUR)} THEN CAST(newUsers AS BIGINT) END), 0) AS BIGINT) AS new_users,
    CAST(COALESCE(SUM(CASE WHEN {_between('d', _WCUR)} THEN CAST(totalUsers AS BIGINT) END), 0) AS BIGINT) AS total_users,
    AVG(CASE WHEN {_between('d', _WCUR)} THEN CAST(bounceRate AS DOUBLE) END) AS avg_bounce_rate,
    COUNT(DISTINCT CASE WHEN {_between('d', _WCUR)} THEN date END) AS days_count,
    CAST(SUM(CASE WHEN {_between('d', _WPREV)} THEN CAST(sessions AS BIGINT) END) AS BIGINT) AS prev_sessions,
    CAST(SUM(CASE WHEN {_between('d', _WPREV)} THEN CAST(newUsers AS BIGINT) END) AS BIGINT) AS prev_new_users
  FROM s WHERE d BETWEEN DATE '{_WPREV[0]}' AND DATE '{_WCUR[1]}')
SELECT sessions, new_users, total_users, {R('avg_bounce_rate')} AS avg_bounce_rate, days_count,
  prev_sessions, prev_new_users,
  {R('1.0 - COALESCE(avg_bounce_rate, 0.0)')} AS engagement_rate,
  CAST(floor(sessions * (1.0 - COALESCE(avg_bounce_rate, 0.0))) AS BIGINT) AS engaged_sessions,
  {R('CASE WHEN prev_sessions <> 0 THEN (sessions - prev_sessions) / abs(prev_sessions) * 100 END')} AS sessions_delta,
  {R('CASE WHEN prev_new_users <> 0 THEN (new_users - prev_new_users) / abs(prev_new_users) * 100 END')} AS new_users_delta
FROM g""", ["web_sessions_raw"])
def a09(t):
    return A.web_summary(ad.web_sessions_raw(t), _WCUR, _WPREV)


@register("a10_traffic_by_source", f"""
SELECT sessionSource AS source, sessionMedium AS medium, CAST(SUM(sessions) AS BIGINT) AS sessions,
  CAST(SUM(totalUsers) AS BIGINT) AS users, CAST(SUM(newUsers) AS BIGINT) AS new_users,
  {R('AVG(bounceRate)')} AS bounce_rate, CAST(SUM(screenPageViews) AS BIGINT) AS page_views
FROM web_traffic WHERE sessionSource IS NOT NULL AND sessionMedium IS NOT NULL
GROUP BY 1, 2 ORDER BY sessions DESC, source, medium LIMIT 20""", ["web_traffic"])
def a10(t):
    g = A.traffic_by_source(ad.web_traffic(t))
    return top_k(g, [F.desc("sessions"), "source", "medium"], 20)


@register("a11_campaign_intent", f"""
WITH g AS (
  SELECT sessionCampaignName AS campaign, sessionMedium AS medium, CAST(SUM(sessions) AS BIGINT) AS sessions,
    AVG(bounceRate) AS bounce_rate, CAST(SUM(screenPageViews) AS BIGINT) AS page_views
  FROM web_traffic WHERE sessionCampaignName IS NOT NULL AND sessionCampaignName <> '(not set)'
  GROUP BY 1, 2 ORDER BY sessions DESC, campaign, medium LIMIT 15)
SELECT campaign, medium, sessions, {R('bounce_rate')} AS bounce_rate, page_views,
  {R('1.0 - bounce_rate')} AS engagement_rate, {R('page_views / NULLIF(sessions, 0)')} AS pages_per_session,
  CASE WHEN bounce_rate > 0.7 THEN 'Poor Match' WHEN bounce_rate < 0.4 THEN 'Good Match' ELSE 'Fair' END AS intent_match
FROM g""", ["web_traffic"])
def a11(t):
    g = A.campaign_intent(ad.web_traffic(t))
    return top_k(g, [F.desc("sessions"), "campaign", "medium"], 15)


@register("a12_landing_pages", f"""
SELECT pagePath AS page_path, pageTitle AS page_title, CAST(SUM(screenPageViews) AS BIGINT) AS page_views,
  CAST(SUM(sessions) AS BIGINT) AS sessions, {R('AVG(bounceRate)')} AS bounce_rate,
  {R('AVG(averageSessionDuration)')} AS avg_duration, {R('1.0 - AVG(bounceRate)')} AS engagement_rate
FROM web_pages WHERE pagePath IS NOT NULL GROUP BY 1, 2
ORDER BY sessions DESC, page_path, page_title LIMIT 25""", ["web_pages"])
def a12(t):
    g = A.landing_pages(ad.web_pages(t))
    return top_k(g, [F.desc("sessions"), "page_path", "page_title"], 25)


@register("a13_funnel_counts", """
WITH s AS (SELECT SUM(sessions) AS sessions, AVG(bounce_rate) AS b FROM web_daily),
p AS (SELECT COUNT(DISTINCT CAST(date_day AS VARCHAR) || '-' || pagePath) AS page_views FROM web_pages)
SELECT CAST(COALESCE(sessions, 0) AS BIGINT) AS sessions, COALESCE(page_views, 0) AS page_views,
  CAST(floor(COALESCE(sessions, 0) * CASE WHEN b IS NULL OR b = 0 THEN 0.5 ELSE 1.0 - b END) AS BIGINT) AS engaged_sessions,
  CAST(0 AS BIGINT) AS conversions
FROM s, p""", ["web_daily", "web_pages"])
def a13(t):
    return A.funnel_counts(ad.web_daily(t), ad.web_pages(t))


@register("a14_event_totals", f"""
SELECT eventName AS event_name, CAST(SUM(eventCount) AS BIGINT) AS total_events,
  CAST(SUM(totalUsers) AS BIGINT) AS total_users, COUNT(DISTINCT date_day) AS days_tracked,
  {R('SUM(eventCount) / NULLIF(SUM(totalUsers), 0)')} AS events_per_user
FROM web_events WHERE eventName IS NOT NULL GROUP BY 1 ORDER BY total_events DESC, event_name LIMIT 20""", ["web_events"])
def a14(t):
    g = A.event_totals(ad.web_events(t))
    return top_k(g, [F.desc("total_events"), "event_name"], 20)


@register("a15_duration_buckets", f"""
WITH b AS (
  SELECT CASE WHEN averageSessionDuration < 10 THEN '0-10s' WHEN averageSessionDuration < 30 THEN '10-30s'
      WHEN averageSessionDuration < 60 THEN '30-60s' WHEN averageSessionDuration < 120 THEN '1-2min'
      WHEN averageSessionDuration < 300 THEN '2-5min' ELSE '5min+' END AS duration_bucket,
    CASE WHEN averageSessionDuration < 10 THEN 1 WHEN averageSessionDuration < 30 THEN 2
      WHEN averageSessionDuration < 60 THEN 3 WHEN averageSessionDuration < 120 THEN 4
      WHEN averageSessionDuration < 300 THEN 5 ELSE 6 END AS bucket_order, sessions
  FROM web_pages WHERE averageSessionDuration IS NOT NULL),
g AS (SELECT duration_bucket, bucket_order, COUNT(*) AS session_count, CAST(SUM(sessions) AS BIGINT) AS sessions
  FROM b GROUP BY 1, 2)
SELECT duration_bucket, bucket_order, session_count, sessions,
  {R('SUM(CASE WHEN bucket_order = 1 THEN session_count ELSE 0 END) OVER () / NULLIF(SUM(session_count) OVER (), 0) * 100')} AS short_share
FROM g""", ["web_pages"])
def a15(t):
    return A.duration_buckets(ad.web_pages(t))


@register("a16_new_vs_returning", f"""
SELECT CAST(SUM(users) AS BIGINT) AS total_users, CAST(SUM(new_users) AS BIGINT) AS new_users,
  CAST(GREATEST(SUM(users) - SUM(new_users), 0) AS BIGINT) AS returning_users,
  {R('COALESCE(SUM(new_users) / NULLIF(SUM(users), 0), 0.0) * 100')} AS new_pct
FROM web_daily""", ["web_daily"])
def a16(t):
    return A.new_vs_returning(ad.web_daily(t))


@register("a17_device_breakdown", f"""
WITH g AS (SELECT deviceCategory AS device, CAST(SUM(sessions) AS BIGINT) AS sessions,
  CAST(SUM(totalUsers) AS BIGINT) AS users, CAST(SUM(screenPageViews) AS BIGINT) AS page_views
  FROM web_tech WHERE deviceCategory IS NOT NULL GROUP BY 1)
SELECT device, sessions, users, page_views, {R('page_views / NULLIF(sessions, 0)')} AS pages_per_session,
  {R('sessions * 100 / NULLIF(SUM(sessions) OVER (), 0)')} AS session_share,
  {R("SUM(CASE WHEN lower(device) = 'mobile' THEN sessions ELSE 0 END) OVER () * 100 / NULLIF(SUM(sessions) OVER (), 0)")} AS mobile_share
FROM g""", ["web_tech"])
def a17(t):
    return A.device_breakdown(ad.web_tech(t))


@register("a18_paid_vs_organic", f"""
SELECT CASE WHEN sessionMedium IN ('cpc','ppc','paidsearch','paid') THEN 'Paid'
    WHEN sessionMedium IN ('organic','referral','direct','(none)') THEN 'Organic' ELSE 'Other' END AS traffic_type,
  CAST(SUM(sessions) AS BIGINT) AS sessions, {R('AVG(bounceRate)')} AS bounce_rate,
  CAST(SUM(screenPageViews) AS BIGINT) AS page_views, {R('1.0 - AVG(bounceRate)')} AS engagement_rate
FROM web_traffic WHERE sessionMedium IS NOT NULL GROUP BY 1""", ["web_traffic"])
def a18(t):
    return A.paid_vs_organic(ad.web_traffic(t))


@register("a19_country_breakdown", f"""
WITH g AS (SELECT country, CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(totalUsers) AS BIGINT) AS users,
  CAST(SUM(newUsers) AS BIGINT) AS new_users FROM web_geo
  WHERE country IS NOT NULL AND country <> '(not set)' GROUP BY 1)
SELECT country, sessions, users, new_users,
  {R('sessions * 100 / NULLIF(SUM(sessions) OVER (), 0)')} AS share,
  {R('MAX(sessions) OVER () * 100 / NULLIF(SUM(sessions) OVER (), 0)')} AS concentration
FROM g""", ["web_geo"])
def a19(t):
    return A.country_breakdown(ad.web_geo(t))


@register("a20_web_daily_trend", f"""
SELECT {DS('date_day')} AS date_day, CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(users) AS BIGINT) AS users,
  {R('AVG(bounce_rate)')} AS bounce_rate, {R('(1.0 - AVG(bounce_rate)) * 100')} AS engagement_pct
FROM web_daily GROUP BY date_day""", ["web_daily"])
def a20(t):
    return A.web_daily_trend(ad.web_daily(t))


# ------------------------------------------------------------------ search / paid
@register("a21_search_daily", f"""
SELECT {DS('date_day')} AS date_day, clicks, impressions FROM organic_daily""", ["organic_daily"])
def a21(t):
    return ad.organic_daily(t).select("date_day", "clicks", "impressions")


@register("a22_top_queries", f"""
SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(position)')} AS avg_position
FROM organic GROUP BY query ORDER BY clicks DESC, query LIMIT 15""", ["organic"])
def a22(t):
    return top_k(A.search_top(ad.organic(t), "query"), [F.desc("clicks"), "query"], 15)


@register("a22_top_pages", f"""
SELECT page, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(position)')} AS avg_position
FROM organic GROUP BY page ORDER BY clicks DESC, page LIMIT 15""", ["organic"])
def a22p(t):
    return top_k(A.search_top(ad.organic(t), "page"), [F.desc("clicks"), "page"], 15)


_GADS = "platform = 'google_ads'"


@register("a23_paid_search_totals", f"""
SELECT CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(spend)')} AS cost, {R('SUM(conversions)')} AS conversions,
  {R('AVG(clicks / NULLIF(impressions, 0))')} AS avg_ctr
FROM ads_lean WHERE {_GADS}""", ["ads_lean"])
def a23(t):
    return A.paid_search_totals(ad.ads(t, dims=False).where(F.col("platform") == "google_ads"))


@register("a24_paid_search_daily", f"""
SELECT {DS('date_day')} AS date_day, {R('SUM(spend)')} AS value FROM ads_lean WHERE {_GADS} GROUP BY date_day""",
          ["ads_lean"])
def a24(t):
    return A.daily_metric(ad.ads(t, dims=False).where(F.col("platform") == "google_ads"), "spend")


def _perf_sql(keys: str, where: str = _GADS, having: str = "") -> str:
    return f"""SELECT {keys}, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
    SUM(spend) AS cost, SUM(conversions) AS conversions, SUM(COALESCE(conversion_value, 0)) AS conversion_value,
    AVG(clicks / NULLIF(impressions, 0)) AS avg_ctr
  FROM ads WHERE {where} GROUP BY {keys} {having}"""


def _rates_sql(prefix: str) -> str:
    return f"""{prefix}impressions, clicks, {R('cost')} AS cost, {R('conversions')} AS conversions,
  {R('conversion_value')} AS conversion_value,
  {R('COALESCE(clicks / NULLIF(impressions, 0), 0.0)')} AS ctr,
  {R('COALESCE(conversions / NULLIF(clicks, 0), 0.0)')} AS conv_rate,
  {R('cost / NULLIF(conversions, 0)')} AS cpa,
  {R('COALESCE(cost / NULLIF(clicks, 0), 0.0)')} AS cpc,
  {R('COALESCE(conversion_value / NULLIF(cost, 0), 0.0)')} AS roas"""


@register("a25_campaign_performance", f"""
WITH g AS ({_perf_sql('campaign_name, campaign_type')})
SELECT {_rates_sql('campaign_name, campaign_type, ')}, {R('avg_ctr')} AS avg_ctr
FROM g ORDER BY cost DESC, campaign_name, campaign_type LIMIT 20""", ["ads"])
def a25(t):
    g = A.campaign_performance(ad.ads(t).where(F.col("platform") == "google_ads"))
    return top_k(g, [F.desc("cost"), "campaign_name", "campaign_type"], 20)


@register("a26_keyword_performance", f"""
WITH g AS ({_perf_sql('keyword_text, keyword_match_type')})
SELECT {_rates_sql('keyword_text, keyword_match_type, ')}
FROM g ORDER BY cost DESC, keyword_text, keyword_match_type LIMIT 15""", ["ads"])
def a26(t):
    g = A.keyword_performance(ad.ads(t).where(F.col("platform") == "google_ads")).drop("avg_ctr")
    return top_k(g, [F.desc("cost"), "keyword_text", "keyword_match_type"], 15)


@register("a27_device_performance", f"""
WITH g AS ({_perf_sql('device', where=_GADS + ' AND device IS NOT NULL').replace('FROM ads ', 'FROM ads_lean ')})
SELECT device, impressions, clicks, {R('cost')} AS cost, {R('conversions')} AS conversions,
  {R('conversion_value')} AS conversion_value, {R('avg_ctr')} AS ctr,
  {R('COALESCE(conversions / NULLIF(clicks, 0), 0.0)')} AS conv_rate, {R('cost / NULLIF(conversions, 0)')} AS cpa,
  {R('COALESCE(cost / NULLIF(clicks, 0), 0.0)')} AS cpc, {R('COALESCE(conversion_value / NULLIF(cost, 0), 0.0)')} AS roas
FROM g""", ["ads_lean"])
def a27(t):
    return A.device_performance(ad.ads(t, dims=False).where(F.col("platform") == "google_ads"))


@register("a28_adgroup_performance", f"""
WITH g AS ({_perf_sql('campaign_name, ad_group_name')})
SELECT {_rates_sql('campaign_name, ad_group_name, ')}
FROM g ORDER BY cost DESC, campaign_name, ad_group_name LIMIT 20""", ["ads"])
def a28(t):
    g = A.adgroup_performance(ad.ads(t).where(F.col("platform") == "google_ads")).drop("avg_ctr")
    return top_k(g, [F.desc("cost"), "campaign_name", "ad_group_name"], 20)


@register("a29_geo_performance", f"""
WITH g AS ({_perf_sql('country_criterion_id', where=_GADS + ' AND country_criterion_id IS NOT NULL').replace('FROM ads ', 'FROM ads_lean ')}),
n AS (SELECT g.*, COALESCE(country_name, 'Unknown (' || CAST(country_criterion_id AS VARCHAR) || ')') AS country
  FROM g LEFT JOIN country_names ON country_criterion_id = criterion_id)
SELECT country_criterion_id, {_rates_sql('country, ')} FROM n
ORDER BY clicks DESC, country_criterion_id LIMIT 15""", ["ads_lean", "country_names"])
def a29(t):
    g = A.geo_performance(ad.ads(t, dims=False).where(F.col("platform") == "google_ads"), ad.country_names(t))
    return top_k(g.drop("avg_ctr"), [F.desc("clicks"), "country_criterion_id"], 15)


@register("a30_hour_totals", f"""
SELECT hour, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(cost)')} AS cost, {R('SUM(conversions)')} AS conversions
FROM hourly WHERE hour IS NOT NULL GROUP BY hour""", ["hourly"])
def a30(t):
    return A.hour_totals(ad.hourly(t))


# ------------------------------------------------------------------- social ads
_META = "platform = 'meta_ads'"


@register("a31_social_kpis", f"""
WITH g AS (SELECT SUM(spend) AS spend, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(reach) AS BIGINT) AS reach, CAST(SUM(clicks) AS BIGINT) AS clicks,
  CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs,
  CAST(SUM(COALESCE(purchases, 0)) AS BIGINT) AS purchases,
  SUM(COALESCE(conversion_value, 0)) AS revenue FROM ads_lean WHERE {_META})
SELECT {R('spend')} AS spend, impressions, reach, clicks, app_installs, purchases, {R('revenue')} AS revenue,
  {R('COALESCE(clicks * 100 / NULLIF(impressions, 0), 0.0)')} AS ctr,
  {R('COALESCE(spend / NULLIF(clicks, 0), 0.0)')} AS cpc,
  {R('COALESCE(spend * 1000 / NULLIF(impressions, 0), 0.0)')} AS cpm,
  {R('COALESCE(impressions / NULLIF(reach, 0), 0.0)')} AS frequency,
  {R('COALESCE(spend / NULLIF(app_installs, 0), 0.0)')} AS cpi,
  {R('COALESCE(revenue / NULLIF(spend, 0), 0.0) * 100')} AS roas_pct
FROM g""", ["ads_lean"])
def a31(t):
    return A.social_kpis(ad.ads(t, dims=False).where(F.col("platform") == "meta_ads"))


_CUT, _PCUT = "2001-10-01", "2001-09-01"


@register("a31_social_kpis_periods", f"""
WITH g AS (SELECT
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN spend END) AS spend,
  SUM(CASE WHEN date_day >= DATE '{_PCUT}' AND date_day < DATE '{_CUT}' THEN spend END) AS prev_spend,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN impressions END) AS impressions,
  SUM(CASE WHEN date_day >= DATE '{_PCUT}' AND date_day < DATE '{_CUT}' THEN impressions END) AS prev_impressions,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN clicks END) AS clicks,
  SUM(CASE WHEN date_day >= DATE '{_PCUT}' AND date_day < DATE '{_CUT}' THEN clicks END) AS prev_clicks,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN COALESCE(app_installs, 0) END) AS app_installs,
  SUM(CASE WHEN date_day >= DATE '{_PCUT}' AND date_day < DATE '{_CUT}' THEN COALESCE(app_installs, 0) END) AS prev_app_installs,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN reach END) AS reach,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN COALESCE(purchases, 0) END) AS purchases,
  SUM(CASE WHEN date_day >= DATE '{_CUT}' THEN COALESCE(conversion_value, 0) END) AS revenue
  FROM ads_lean WHERE {_META} AND date_day >= DATE '{_PCUT}')
SELECT {R('spend')} AS spend, {R('prev_spend')} AS prev_spend, CAST(impressions AS BIGINT) AS impressions,
  CAST(prev_impressions AS BIGINT) AS prev_impressions, CAST(clicks AS BIGINT) AS clicks, CAST(prev_clicks AS BIGINT) AS prev_clicks,
  CAST(app_installs AS BIGINT) AS app_installs, CAST(prev_app_installs AS BIGINT) AS prev_app_installs,
  CAST(reach AS BIGINT) AS reach, CAST(purchases AS BIGINT) AS purchases, {R('revenue')} AS revenue,
  {R('COALESCE(clicks * 100 / NULLIF(impressions, 0), 0.0)')} AS ctr, {R('COALESCE(spend / NULLIF(clicks, 0), 0.0)')} AS cpc,
  {R('COALESCE(spend * 1000 / NULLIF(impressions, 0), 0.0)')} AS cpm,
  {R('COALESCE(impressions / NULLIF(reach, 0), 0.0)')} AS frequency,
  {R('COALESCE(spend / NULLIF(app_installs, 0), 0.0)')} AS cpi, {R('COALESCE(revenue / NULLIF(spend, 0), 0.0) * 100')} AS roas_pct,
  {R('CASE WHEN prev_spend > 0 THEN (spend - prev_spend) / prev_spend * 100 END')} AS spend_delta,
  {R('CASE WHEN prev_clicks > 0 THEN (clicks - prev_clicks) / prev_clicks * 100 END')} AS clicks_delta,
  {R('CASE WHEN prev_app_installs > 0 THEN (app_installs - prev_app_installs) / prev_app_installs * 100 END')} AS installs_delta
FROM g""", ["ads_lean"])
def a31p(t):
    return A.social_kpis_periods(ad.ads(t, dims=False).where(F.col("platform") == "meta_ads"), _CUT, _PCUT)


@register("a32_social_daily", f"""
WITH g AS (SELECT date_day, SUM(spend) AS spend, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs
  FROM ads_lean WHERE {_META} GROUP BY date_day)
SELECT {DS('date_day')} AS date_day, {R('spend')} AS spend, impressions, clicks, app_installs,
  {R('COALESCE(clicks * 100 / NULLIF(impressions, 0), 0.0)')} AS ctr,
  {R('COALESCE(spend / NULLIF(clicks, 0), 0.0)')} AS cpc
FROM g""", ["ads_lean"])
def a32(t):
    return A.social_daily(ad.ads(t, dims=False).where(F.col("platform") == "meta_ads"))


def _social_table_sql(level: str, limit: str) -> str:
    return f"""
WITH g AS (SELECT {level}, SUM(spend) AS spend, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(reach) AS BIGINT) AS reach, CAST(SUM(clicks) AS BIGINT) AS clicks,
  CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs,
  CAST(SUM(COALESCE(purchases, 0)) AS BIGINT) AS purchases, SUM(COALESCE(conversion_value, 0)) AS revenue
  FROM ads WHERE {_META} GROUP BY {level})
SELECT {level}, {R('spend')} AS spend, impressions, reach, clicks, app_installs, purchases, {R('revenue')} AS revenue,
  {R('COALESCE(clicks * 100 / NULLIF(impressions, 0), 0.0)')} AS ctr,
  {R('COALESCE(spend / NULLIF(clicks, 0), 0.0)')} AS cpc,
  {R('COALESCE(spend * 1000 / NULLIF(impressions, 0), 0.0)')} AS cpm,
  {R('COALESCE(spend / NULLIF(app_installs, 0), 0.0)')} AS cpi
FROM g {limit}"""


@register("a33_social_campaigns", _social_table_sql("campaign_name", ""), ["ads"])
def a33(t):
    return A.social_campaigns(ad.ads(t).where(F.col("platform") == "meta_ads"))


@register("a33_top_spend_campaigns",
          _social_table_sql("campaign_name", "WHERE spend > 0 ORDER BY spend DESC, campaign_name LIMIT 10"), ["ads"])
def a33t(t):
    g = A.social_campaigns(ad.ads(t).where(F.col("platform") == "meta_ads")).where(F.col("spend") > 0)
    return top_k(g, [F.desc("spend"), "campaign_name"], 10)


@register("a35_social_adsets",
          _social_table_sql("ad_group_name, campaign_name", "ORDER BY spend DESC, ad_group_name, campaign_name LIMIT 20"), ["ads"])
def a35(t):
    g = A.social_campaigns(ad.ads(t).where(F.col("platform") == "meta_ads"), level=["ad_group_name", "campaign_name"])
    return top_k(g, [F.desc("spend"), "ad_group_name", "campaign_name"], 20)


# the columns that the oracle's matrix must have: all 25 brands of the driver's parts
PIVOT_CAMPAIGNS = tuple(f"Brand#{n}" for n in range(1, 26))


@register("a34_spend_pivot", f"""
SELECT {DS('date_day')} AS date_day,
  {', '.join(R(f"COALESCE(SUM(CASE WHEN campaign_name = '{c}' THEN spend END), 0.0)") + f' AS "{c}"' for c in PIVOT_CAMPAIGNS)}
FROM ads WHERE {_META} GROUP BY date_day""", ["ads"])
def a34(t):
    return A.spend_pivot(ad.ads(t).where(F.col("platform") == "meta_ads"))


@register("a34_spend_by_campaign", f"""
SELECT {DS('date_day')} AS date_day, campaign_name, {R('SUM(spend)')} AS spend
FROM ads WHERE {_META} GROUP BY date_day, campaign_name""", ["ads"])
def a34_long(t):
    return A.spend_by_campaign(ad.ads(t).where(F.col("platform") == "meta_ads"))


def _bd_sql(dims: str) -> str:
    return f"""
WITH g AS (SELECT {dims}, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  SUM(spend) AS spend, CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs
  FROM social_breakdowns GROUP BY {dims})
SELECT {dims}, impressions, clicks, {R('spend')} AS spend, app_installs,
  {R('COALESCE(clicks * 100 / NULLIF(impressions, 0), 0.0)')} AS ctr,
  {R('COALESCE(spend / NULLIF(clicks, 0), 0.0)')} AS cpc,
  {R('COALESCE(spend * 1000 / NULLIF(impressions, 0), 0.0)')} AS cpm
FROM g"""


@register("a36_social_geo", _bd_sql("country"), ["social_breakdowns"])
def a36(t):
    return A.social_breakdown(ad.social_breakdowns(t), ["country"])


def _rollup_sql(a: str, b: str) -> str:
    return f"""
SELECT {a}, {b}, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(spend)')} AS spend, CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs,
  CASE WHEN GROUPING({a}) = 0 AND GROUPING({b}) = 0 THEN '{a}_x_{b}' WHEN GROUPING({b}) = 1 THEN '{a}' ELSE '{b}' END AS level,
  {R('COALESCE(SUM(clicks) * 100 / NULLIF(SUM(impressions), 0), 0.0)')} AS ctr,
  {R('COALESCE(SUM(spend) / NULLIF(SUM(clicks), 0), 0.0)')} AS cpc
FROM social_breakdowns GROUP BY GROUPING SETS (({a}, {b}), ({a}), ({b}))"""


@register("a37_device_publisher", _rollup_sql("device_platform", "publisher_platform"), ["social_breakdowns"])
def a37(t):
    return A.social_rollup(ad.social_breakdowns(t), "device_platform", "publisher_platform")


@register("a38_age_gender", _rollup_sql("age", "gender"), ["social_breakdowns"])
def a38(t):
    return A.social_rollup(ad.social_breakdowns(t), "age", "gender")


@register("a38_age_gender_matrix", f"""
SELECT age,
  {R("COALESCE(SUM(CASE WHEN gender = 'female' THEN spend END), 0.0)")} AS female,
  {R("COALESCE(SUM(CASE WHEN gender = 'male' THEN spend END), 0.0)")} AS male,
  {R("COALESCE(SUM(CASE WHEN gender = 'unknown' THEN spend END), 0.0)")} AS unknown,
  CASE age WHEN '13-17' THEN 0 WHEN '18-24' THEN 1 WHEN '25-34' THEN 2 WHEN '35-44' THEN 3
    WHEN '45-54' THEN 4 WHEN '55-64' THEN 5 WHEN '65+' THEN 6 ELSE 7 END AS age_order
FROM social_breakdowns GROUP BY age""", ["social_breakdowns"])
def a38m(t):
    return A.age_gender_matrix(ad.social_breakdowns(t))


# ------------------------------------------------------------------------ posts
@register("a39_post_totals", f"""
SELECT COUNT(*) AS total_posts, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(likes) AS BIGINT) AS likes,
  CAST(SUM(retweets) AS BIGINT) AS retweets, CAST(SUM(replies) AS BIGINT) AS replies,
  CAST(SUM(quotes) AS BIGINT) AS quotes, CAST(SUM(bookmarks) AS BIGINT) AS bookmarks,
  CAST(SUM(likes + retweets + replies + quotes + bookmarks) AS BIGINT) AS engagements,
  {R('AVG(likes)')} AS avg_likes, {R('AVG(retweets)')} AS avg_retweets,
  {R('SUM(likes + retweets + replies + quotes + bookmarks) / CASE WHEN COALESCE(SUM(impressions), 0) = 0 THEN 1 ELSE SUM(impressions) END * 100')} AS engagement_rate
FROM posts""", ["posts"])
def a39(t):
    return A.post_totals(ad.posts(t))


@register("a40_post_types", f"""
SELECT tweet_type, COUNT(*) AS count, {R('AVG(impressions)')} AS avg_impressions, {R('AVG(likes)')} AS avg_likes,
  CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(likes) AS BIGINT) AS likes, CAST(SUM(retweets) AS BIGINT) AS retweets,
  {R('AVG(likes) + SUM(impressions) / COUNT(*) * 0.01')} AS avg_engagement
FROM posts GROUP BY tweet_type""", ["posts"])
def a40(t):
    return A.post_types(ad.posts(t))


@register("a41_post_daily", f"""
WITH g AS (SELECT created_date, COUNT(*) AS tweet_count, CAST(SUM(impressions) AS BIGINT) AS total_impressions,
  CAST(SUM(likes) AS BIGINT) AS total_likes, CAST(SUM(retweets) AS BIGINT) AS total_retweets,
  CAST(SUM(replies) AS BIGINT) AS total_replies,
  CAST(SUM(likes + retweets + replies + quotes + bookmarks) AS BIGINT) AS total_engagements
  FROM posts GROUP BY created_date)
SELECT {DS('created_date')} AS created_date, tweet_count, total_impressions, total_likes, total_retweets,
  total_replies, total_engagements,
  CAST(round_even(CAST(CAST(total_engagements AS DOUBLE) / CASE WHEN total_impressions = 0 THEN 1 ELSE total_impressions END * 100
    AS DECIMAL(38,9)), 2) AS DOUBLE) AS engagement_rate
FROM g""", ["posts"])
def a41(t):
    return A.post_daily(ad.posts(t))


@register("a42_insight_inputs", f"""
SELECT {DS('date_day')} AS date_day, {R('SUM(spend)')} AS cost, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(conversions)')} AS conversions, CAST(SUM(impressions) AS BIGINT) AS impressions
FROM ads_lean WHERE {_GADS} AND date_day >= DATE '{LI_ASOF}' - INTERVAL 30 DAY GROUP BY date_day""", ["ads_lean"])
def a42(t):
    from mkpulse.operators.insights import insight_inputs

    return insight_inputs(ad.ads(t, dims=False).where(F.col("platform") == "google_ads"), LI_ASOF, 30)


# ---------------------------------------------------------------------- advanced
_KW_SQL = f"""
WITH g AS ({_perf_sql('keyword_text, keyword_match_type, campaign_name', having='HAVING SUM(impressions) > 0')})
SELECT keyword_text, keyword_match_type, campaign_name, impressions, clicks, {R('cost')} AS cost,
  {R('conversions')} AS conversions, {R('conversion_value')} AS conversion_value,
  {R('COALESCE(conversions / NULLIF(clicks, 0), 0.0) * 100')} AS conv_rate,
  {R('cost / NULLIF(conversions, 0)')} AS cpa
FROM g"""


@register("a43_keyword_campaign", _KW_SQL, ["ads"])
def a43(t):
    return A.keyword_campaign(ad.ads(t).where(F.col("platform") == "google_ads"))


@register("a44_match_type_summary", f"""
WITH g AS ({_perf_sql('keyword_text, keyword_match_type, campaign_name', having='HAVING SUM(impressions) > 0')})
SELECT keyword_match_type, COUNT(*) AS keywords, {R('SUM(cost)')} AS cost, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(conversions)')} AS conversions, {R('SUM(cost) / NULLIF(SUM(conversions), 0)')} AS cpa
FROM g GROUP BY keyword_match_type""", ["ads"])
def a44(t):
    return A.match_type_summary(A.keyword_campaign(ad.ads(t).where(F.col("platform") == "google_ads")))


@register("a46_platform_spend", f"""
SELECT platform, {R('SUM(spend)')} AS total_spend, CAST(SUM(clicks) AS BIGINT) AS total_clicks,
  CAST(SUM(impressions) AS BIGINT) AS total_impressions, {R(f'SUM({CONV})')} AS total_conversions
FROM ads_lean GROUP BY platform""", ["ads_lean"])
def a46(t):
    return A.platform_spend(ad.ads(t, dims=False))


@register("a47_account_comparison", f"""
WITH g AS (SELECT account_id, campaign_name, SUM(spend) AS spend, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS app_installs
  FROM ads WHERE {_META} GROUP BY 1, 2)
SELECT account_id, campaign_name, {R('spend')} AS spend, impressions, clicks, app_installs,
  CAST(ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY spend DESC, campaign_name) AS INTEGER) AS spend_rank,
  {R('SUM(spend) OVER (PARTITION BY account_id)')} AS account_spend
FROM g""", ["ads"])
def a47(t):
    return A.account_comparison(ad.ads(t).where(F.col("platform") == "meta_ads"))


@register("a48_actual_cpc", f"""
SELECT campaign_name, CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(cost_micros) / 1e6 / NULLIF(SUM(clicks), 0)')} AS actual_cpc
FROM ads WHERE {_GADS} GROUP BY campaign_name""", ["ads"])
def a48(t):
    return A.actual_cpc(ad.ads(t).where(F.col("platform") == "google_ads"))


@register("a49_source_revenue", """
SELECT sessionSource AS source, sessionMedium AS medium, CAST(SUM(sessions) AS BIGINT) AS sessions,
  CAST(SUM(screenPageViews) AS BIGINT) AS revenue
FROM web_traffic WHERE date_day >= DATE '2024-01-10' GROUP BY 1, 2
ORDER BY revenue DESC, source, medium LIMIT 10""", ["web_traffic"])
def a49(t):
    g = A.source_revenue(ad.web_traffic(t).where(F.col("date_day") >= F.lit("2024-01-10").cast("date")))
    return top_k(g, [F.desc("revenue"), "source", "medium"], 10)


@register("a50_top_converting_keywords", f"""
SELECT keyword_text, keyword_match_type, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(spend)')} AS spend, {R('SUM(conversions)')} AS conversions
FROM ads WHERE {_GADS} AND clicks > 0 GROUP BY keyword_text, keyword_match_type
ORDER BY conversions DESC, keyword_text, keyword_match_type LIMIT 20""", ["ads"])
def a50(t):
    ads = ad.ads(t).where((F.col("platform") == "google_ads") & (F.col("clicks") > 0))
    g = ads.groupBy("keyword_text", "keyword_match_type").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("spend").alias("spend"), F.sum("conversions").alias("conversions"),
    )
    return top_k(g, [F.desc("conversions"), "keyword_text", "keyword_match_type"], 20)


@register("a50_top_seo_queries", f"""
SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(position)')} AS avg_position
FROM organic GROUP BY query ORDER BY clicks DESC, query LIMIT 20""", ["organic"])
def a50q(t):
    return top_k(A.search_top(ad.organic(t), "query"), [F.desc("clicks"), "query"], 20)


@register("a46_cross_platform_spend", f"""
SELECT platform, {R('SUM(spend)')} AS total_spend FROM ads_lean GROUP BY platform
UNION ALL
SELECT 'organic', CAST(0 AS DOUBLE) FROM (SELECT 1 FROM organic_daily LIMIT 1)""", ["ads_lean", "organic_daily"])
def a46c(t):
    return A.cross_platform_spend(ad.ads(t, dims=False), ad.organic_daily(t))


@register("a50_cost_per_install", f"""
SELECT campaign_name, {R('SUM(spend)')} AS spend, CAST(SUM(COALESCE(app_installs, 0)) AS BIGINT) AS installs,
  {R('COALESCE(SUM(spend) / NULLIF(SUM(COALESCE(app_installs, 0)), 0), 0.0)')} AS cost_per_install
FROM ads WHERE {_META} GROUP BY campaign_name""", ["ads"])
def a50c(t):
    return A.cost_per_install(ad.ads(t).where(F.col("platform") == "meta_ads"))
