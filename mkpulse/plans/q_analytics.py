"""Registered queries: joins (J), windows (W), scores and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse.functions.periods import comparison_range, preset_range
from mkpulse.operators import aggregates as A
from mkpulse.operators import joins as J
from mkpulse.operators import scoring as N
from mkpulse.operators import windows as W
from mkpulse.operators.topk import top_k
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register
from mkpulse.plans.q_aggregates import CONV, EV_ASOF, LI_ASOF, _between

_G = "platform = 'google_ads'"
_M = "platform = 'meta_ads'"


def _google(t, dims=True):
    return ad.ads(t, dims=dims).where(F.col("platform") == "google_ads")


def _meta(t, dims=True):
    return ad.ads(t, dims=dims).where(F.col("platform") == "meta_ads")


# ------------------------------------------------------------------------- joins
@register("j01_daily_trend", f"""
WITH p AS (SELECT date_day, SUM(spend) AS paid_spend, SUM({CONV}) AS conversions FROM ads_lean GROUP BY 1),
w AS (SELECT date_day, SUM(sessions) AS sessions FROM web_daily GROUP BY 1),
o AS (SELECT date_day, SUM(clicks) AS organic_clicks FROM organic_daily GROUP BY 1)
SELECT {DS('COALESCE(p.date_day, w.date_day, o.date_day)')} AS date_day,
  {R('COALESCE(paid_spend, 0)')} AS paid_spend, CAST(COALESCE(sessions, 0) AS BIGINT) AS sessions,
  {R('COALESCE(conversions, 0)')} AS conversions, CAST(COALESCE(organic_clicks, 0) AS BIGINT) AS organic_clicks
FROM p FULL OUTER JOIN w ON p.date_day = w.date_day
FULL OUTER JOIN o ON COALESCE(p.date_day, w.date_day) = o.date_day""", ["ads_lean", "web_daily", "organic_daily"])
def j01(t):
    return J.daily_trend(ad.ads(t, dims=False), ad.web_daily(t), ad.organic_daily(t))


_J02_CTE = f"""o AS (SELECT lower(query) AS keyword, SUM(clicks) AS organic_clicks, SUM(impressions) AS organic_impressions,
    AVG(position) AS avg_position FROM organic GROUP BY 1 HAVING SUM(impressions) > 100),
p AS (SELECT lower(keyword_text) AS keyword, SUM(clicks) AS paid_clicks, SUM(spend) AS paid_spend,
    SUM(conversions) AS paid_conversions FROM ads WHERE {_G} GROUP BY 1 HAVING SUM(impressions) > 0),
j AS (SELECT o.keyword, organic_clicks, avg_position, paid_clicks, paid_spend, paid_conversions
  FROM o JOIN p ON o.keyword = p.keyword)"""


@register("j02_seo_ppc_overlap", f"""
WITH {_J02_CTE}
SELECT keyword, CAST(organic_clicks AS BIGINT) AS organic_clicks, {R('avg_position')} AS avg_position,
  CAST(paid_clicks AS BIGINT) AS paid_clicks, {R('paid_spend')} AS paid_spend, {R('paid_conversions')} AS paid_conversions
FROM j""", ["organic", "ads"])
def j02(t):
    return J.seo_ppc_overlap(ad.organic(t), _google(t))


def _upsert_frames(t):
    """Target: all lines as landed on day 0; batch: a 90-day lookback re-pull
    (ship date >= 2001-08-03) landed on day 1 with corrected quantities."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    tgt = li.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(0).alias("landed_day"))
    bat = li.where(F.col("l_shipdate") >= F.lit("2001-08-03").cast("timestamp")).select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") + 1).alias("l_quantity"), F.lit(1).alias("landed_day")
    )
    return tgt, bat


_UPSERT_CTE = """tgt AS (SELECT l_orderkey, l_linenumber, l_quantity, 0 AS landed_day FROM lineitem),
bat AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, 1 AS landed_day FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '2001-08-03 00:00:00')"""


@register("j03_k02_upsert", f"""
WITH {_UPSERT_CTE}
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, landed_day FROM tgt
WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey IS NOT DISTINCT FROM tgt.l_orderkey
  AND bat.l_linenumber IS NOT DISTINCT FROM tgt.l_linenumber)
UNION ALL SELECT l_orderkey, l_linenumber, {R('l_quantity')}, landed_day FROM bat""")
def j03(t):
    from mkpulse.sinks import upsert_frame

    tgt, bat = _upsert_frames(t)
    return upsert_frame(tgt, bat, ["l_orderkey", "l_linenumber"])


@register("j04_replaced_rows", f"""
WITH {_UPSERT_CTE}
SELECT COUNT(*) AS replaced_rows FROM tgt
WHERE EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = tgt.l_orderkey AND bat.l_linenumber = tgt.l_linenumber)""")
def j04(t):
    tgt, bat = _upsert_frames(t)
    return J.semi_by_keys(tgt, bat, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("replaced_rows"))


_WC = preset_range(EV_ASOF, 14)
_WP = comparison_range(*_WC)


@register("j05_source_period_match", f"""
WITH c AS (SELECT sessionSource AS source, sessionMedium AS medium, SUM(sessions) AS sessions, AVG(bounceRate) AS bounce_rate
  FROM web_traffic WHERE {_between('date_day', _WC)} GROUP BY 1, 2),
p AS (SELECT sessionSource AS source, sessionMedium AS medium, SUM(sessions) AS sessions, AVG(bounceRate) AS bounce_rate
  FROM web_traffic WHERE {_between('date_day', _WP)} GROUP BY 1, 2)
SELECT c.source, c.medium, CAST(c.sessions AS BIGINT) AS sessions, {R('c.bounce_rate')} AS bounce_rate,
  CAST(p.sessions AS BIGINT) AS sessions_prev, {R('p.bounce_rate')} AS bounce_rate_prev,
  {R('CASE WHEN p.sessions > 0 THEN (c.sessions - p.sessions) / p.sessions * 100 END')} AS sessions_change,
  {R('CASE WHEN p.bounce_rate > 0 THEN (c.bounce_rate - p.bounce_rate) / p.bounce_rate * 100 END')} AS bounce_rate_change
FROM c JOIN p ON c.source = p.source AND c.medium = p.medium""", ["web_traffic"])
def j05(t):
    from mkpulse.functions.periods import filter_period

    wt = ad.web_traffic(t)
    cur = A.traffic_by_source(filter_period(wt, "date_day", *_WC))
    prev = A.traffic_by_source(filter_period(wt, "date_day", *_WP))
    return J.period_match(cur, prev, ["source", "medium"], ["sessions", "bounce_rate"])


@register("j08_campaign_vs_average", f"""
WITH g AS (SELECT campaign_name, SUM(spend) AS cost FROM ads WHERE {_G} GROUP BY 1),
s AS (SELECT AVG(cost) AS avg_cost, SUM(cost) AS total_cost FROM g)
SELECT campaign_name, {R('cost')} AS cost, {R('avg_cost')} AS avg_cost, {R('total_cost')} AS total_cost,
  {R('cost / avg_cost')} AS cost_index
FROM g JOIN s ON TRUE""", ["ads"])
def j08(t):
    g = _google(t).groupBy("campaign_name").agg(F.sum("spend").alias("cost"))
    s = g.agg(F.avg("cost").alias("avg_cost"), F.sum("cost").alias("total_cost"))
    return J.attach_scalars(g, s).withColumn("cost_index", F.col("cost") / F.col("avg_cost"))


@register("j09_keep_newest_semi", f"""
WITH m AS (SELECT l_orderkey, l_linenumber, MAX(extracted_at) AS mx FROM dup_lines GROUP BY 1, 2)
SELECT d.l_orderkey, d.l_linenumber, {R('d.l_quantity')} AS l_quantity, {R('d.l_extendedprice')} AS l_extendedprice,
  {DS('d.extracted_at')} AS extracted_at
FROM dup_lines d WHERE EXISTS (SELECT 1 FROM m WHERE m.l_orderkey = d.l_orderkey AND m.l_linenumber = d.l_linenumber
  AND m.mx = d.extracted_at)""", ["dup_lines"])
def j09(t):
    return J.keep_newest_semi(ad.dup_lines(t), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------------ windows
@register("w01_keep_latest", f"""
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, {R('l_extendedprice')} AS l_extendedprice,
  {DS('extracted_at')} AS extracted_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY extracted_at DESC NULLS LAST, l_quantity DESC, l_extendedprice DESC) AS rn FROM dup_lines) WHERE rn = 1""", ["dup_lines"])
def w01(t):
    return W.keep_latest(ad.dup_lines(t), ["l_orderkey", "l_linenumber"], "extracted_at", ["l_quantity", "l_extendedprice"])


_DAILY_G = f"SELECT date_day, SUM(spend) AS cost, SUM(clicks) AS clicks, SUM(conversions) AS conversions, SUM(impressions) AS impressions FROM ads_lean WHERE {_G} GROUP BY date_day"


def _daily_google(t):
    return A.daily_metric(_google(t, dims=False), "spend").withColumnRenamed("value", "cost")


@register("w02_spend_anomalies", f"""
WITH d AS ({_DAILY_G}),
n AS (SELECT COUNT(*) AS n FROM d),
r AS (SELECT date_day, cost,
  CASE WHEN COUNT(cost) OVER w >= 3 THEN AVG(cost) OVER w END AS rolling_mean,
  CASE WHEN COUNT(cost) OVER w >= 3 THEN STDDEV_SAMP(cost) OVER w END AS rolling_std
  FROM d WINDOW w AS (ORDER BY date_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (cost - rolling_mean) / NULLIF(rolling_std, 0) AS z_score FROM r)
SELECT {DS('date_day')} AS date_day, {R('cost')} AS cost, {R('rolling_mean')} AS rolling_mean,
  {R('rolling_std')} AS rolling_std, {R('z_score')} AS z_score,
  CASE WHEN z_score > 1.5 THEN 'spike' WHEN z_score < -1.5 THEN 'drop' ELSE 'normal' END AS anomaly_type,
  COALESCE(abs(z_score) > 1.5, FALSE) AS is_anomaly,
  {R('(cost - rolling_mean) / NULLIF(rolling_mean, 0) * 100')} AS deviation_pct
FROM z WHERE (SELECT n FROM n) >= 7""", ["ads_lean"])
def w02(t):
    return W.rolling_anomalies(_daily_google(t), "cost", threshold=1.5)


@register("w02_spend_anomalies_prior_rows", f"""
WITH d AS ({_DAILY_G}),
n AS (SELECT COUNT(*) AS n FROM d),
r AS (SELECT date_day, cost,
  CASE WHEN COUNT(cost) OVER w >= 3 THEN AVG(cost) OVER w END AS rolling_mean,
  CASE WHEN COUNT(cost) OVER w >= 3 THEN STDDEV_SAMP(cost) OVER w END AS rolling_std
  FROM d WINDOW w AS (ORDER BY date_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (cost - rolling_mean) / NULLIF(rolling_std, 0) AS z_score FROM r)
SELECT {DS('date_day')} AS date_day, {R('cost')} AS cost, {R('rolling_mean')} AS rolling_mean,
  {R('rolling_std')} AS rolling_std, {R('z_score')} AS z_score,
  CASE WHEN z_score > 2.5 THEN 'spike' WHEN z_score < -2.5 THEN 'drop' ELSE 'normal' END AS anomaly_type,
  COALESCE(abs(z_score) > 2.5, FALSE) AS is_anomaly,
  {R('(cost - rolling_mean) / NULLIF(rolling_mean, 0) * 100')} AS deviation_pct
FROM z WHERE (SELECT n FROM n) >= 7""", ["ads_lean"])
def w02p(t):
    return W.rolling_anomalies(_daily_google(t), "cost", include_current=False)


@register("w03_moving_average", f"""
WITH d AS ({_DAILY_G})
SELECT {DS('date_day')} AS date_day, {R('cost')} AS cost,
  {R('CASE WHEN COUNT(*) OVER w = 7 THEN AVG(cost) OVER w END')} AS ma
FROM d WINDOW w AS (ORDER BY date_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", ["ads_lean"])
def w03(t):
    return W.moving_average(_daily_google(t).select("date_day", "cost"), "cost")


@register("w03_event_moving_average", f"""
SELECT event_id, {DS('ts')} AS ts, {R('CASE WHEN COUNT(*) OVER w = 25 THEN AVG(value) OVER w END')} AS ma
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""")
def w03_events(t):
    """Over the single events of the whole stream: one series of any length, rolled over in ranges with a halo."""
    return W.moving_average(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"], 25, spread=2_000).drop("value")


@register("w02_event_anomalies", f"""
WITH r AS (SELECT event_type, ts, event_id, value,
  CASE WHEN COUNT(value) OVER w >= 3 THEN AVG(value) OVER w END AS rolling_mean,
  CASE WHEN COUNT(value) OVER w >= 3 THEN STDDEV_SAMP(value) OVER w END AS rolling_std, COUNT(*) OVER (PARTITION BY event_type) AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (value - rolling_mean) / NULLIF(rolling_std, 0) AS z_score FROM r)
SELECT event_type, event_id, {R('value')} AS value, {R('rolling_mean')} AS rolling_mean, {R('z_score')} AS z_score,
  CASE WHEN z_score > 2.5 THEN 'spike' ELSE 'drop' END AS anomaly_type
FROM z WHERE n >= 7 AND abs(z_score) > 2.5""")
def w02_events(t):
    """Single events against the twelve before them of their type: a type may hold any share of the stream."""
    out = W.rolling_anomalies(t.events.select("event_type", "ts", "event_id", "value"), "value", ["ts", "event_id"], ["event_type"], threshold=2.5,
                              window=12, include_current=False, spread=2_000)
    return out.where("is_anomaly").select("event_type", "event_id", "value", "rolling_mean", "z_score", "anomaly_type")


@register("w04_last_vs_previous", f"""
WITH d AS ({_DAILY_G.replace('GROUP BY', f"AND date_day >= DATE '{LI_ASOF}' - INTERVAL 7 DAY GROUP BY")}),
l AS (SELECT *, LAG(cost) OVER (ORDER BY date_day) AS prev_cost, LAG(conversions) OVER (ORDER BY date_day) AS prev_conversions,
  ROW_NUMBER() OVER (ORDER BY date_day DESC) AS rd, COUNT(*) OVER () AS n FROM d)
SELECT {DS('date_day')} AS date_day, {R('cost')} AS cost, {R('conversions')} AS conversions,
  {R('prev_cost')} AS prev_cost, {R('prev_conversions')} AS prev_conversions,
  {R('CASE WHEN prev_cost > 0 THEN (cost - prev_cost) / prev_cost END')} AS cost_change,
  {R('CASE WHEN prev_conversions > 0 THEN (conversions - prev_conversions) / prev_conversions END')} AS conversions_change
FROM l WHERE rd = 1 AND n >= 2""", ["ads_lean"])
def w04(t):
    from mkpulse.operators.insights import insight_inputs

    d = insight_inputs(_google(t, dims=False), LI_ASOF, 7).select("date_day", "cost", "conversions")
    return W.last_vs_previous(d, ["cost", "conversions"])


@register("w05_first_last_week", f"""
WITH d AS (SELECT date_day, SUM(clicks) AS clicks FROM organic WHERE date_day >= DATE '2001-07-25' GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date_day) AS ra, ROW_NUMBER() OVER (ORDER BY date_day DESC) AS rdesc FROM d),
g AS (SELECT COUNT(*) AS days, SUM(CASE WHEN rdesc <= 7 THEN clicks END) AS this_week,
  SUM(CASE WHEN ra <= 7 THEN clicks END) AS last_week FROM r)
SELECT days, CAST(this_week AS BIGINT) AS this_week, CAST(last_week AS BIGINT) AS last_week,
  {R('CASE WHEN last_week > 0 THEN (this_week - last_week) / last_week END')} AS week_change
FROM g WHERE days >= 7""", ["organic"])
def w05(t):
    d = ad.organic(t).where(F.col("date_day") >= F.lit("2001-07-25").cast("date")).groupBy("date_day").agg(
        F.sum("clicks").alias("clicks")
    )
    return W.first_last_window(d, "clicks")


@register("w06_half_split", f"""
WITH d AS (SELECT date_day, SUM(sessions) AS sessions, (1.0 - AVG(bounce_rate)) * 100 AS engagement_rate
  FROM web_daily GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date_day) AS rn, COUNT(*) OVER () AS n FROM d),
g AS (SELECT MAX(n) AS n_rows,
  AVG(CASE WHEN rn <= n // 2 THEN sessions END) AS first_sessions, AVG(CASE WHEN rn > n // 2 THEN sessions END) AS second_sessions,
  AVG(CASE WHEN rn <= n // 2 THEN engagement_rate END) AS first_engagement_rate,
  AVG(CASE WHEN rn > n // 2 THEN engagement_rate END) AS second_engagement_rate FROM r)
SELECT n_rows, {R('first_sessions')} AS first_sessions, {R('second_sessions')} AS second_sessions,
  {R('first_engagement_rate')} AS first_engagement_rate, {R('second_engagement_rate')} AS second_engagement_rate,
  {R('CASE WHEN first_sessions <> 0 THEN (second_sessions - first_sessions) / abs(first_sessions) * 100 END')} AS sessions_change,
  {R('CASE WHEN first_engagement_rate <> 0 THEN (second_engagement_rate - first_engagement_rate) / abs(first_engagement_rate) * 100 END')} AS engagement_rate_change
FROM g""", ["web_daily"])
def w06(t):
    d = A.web_daily_trend(ad.web_daily(t)).withColumnRenamed("engagement_pct", "engagement_rate")
    return W.half_split(d.select("date_day", "sessions", "engagement_rate"), ["sessions", "engagement_rate"])


@register("w08_max_normalize", f"""
WITH p AS (SELECT date_day, SUM(spend) AS paid_spend, SUM({CONV}) AS conversions FROM ads_lean GROUP BY 1),
o AS (SELECT date_day, SUM(clicks) AS organic_clicks FROM organic_daily GROUP BY 1),
j AS (SELECT COALESCE(p.date_day, o.date_day) AS date_day, COALESCE(paid_spend, 0) AS paid_spend,
  COALESCE(conversions, 0) AS conversions, COALESCE(organic_clicks, 0) AS organic_clicks
  FROM p FULL OUTER JOIN o ON p.date_day = o.date_day)
SELECT {DS('date_day')} AS date_day, {R('paid_spend')} AS paid_spend, {R('conversions')} AS conversions,
  CAST(organic_clicks AS BIGINT) AS organic_clicks,
  {R('CASE WHEN MAX(paid_spend) OVER () > 0 THEN paid_spend / MAX(paid_spend) OVER () * 100 ELSE paid_spend END')} AS paid_spend_norm,
  {R('CASE WHEN MAX(organic_clicks) OVER () > 0 THEN organic_clicks / MAX(organic_clicks) OVER () * 100 ELSE organic_clicks END')} AS organic_clicks_norm
FROM j""", ["ads_lean", "organic_daily"])
def w08(t):
    p = ad.ads(t, dims=False).groupBy("date_day").agg(F.sum("spend").alias("paid_spend"), F.sum(A._conv()).alias("conversions"))
    o = ad.organic_daily(t).groupBy("date_day").agg(F.sum("clicks").alias("organic_clicks"))
    j = p.join(o, "date_day", "full").fillna(0, subset=["paid_spend", "conversions", "organic_clicks"])
    return W.max_normalize(j, ["paid_spend", "organic_clicks"])


@register("w09_minmax_sessions", f"""
WITH d AS (SELECT date_day, SUM(sessions) AS sessions FROM web_daily GROUP BY 1)
SELECT {DS('date_day')} AS date_day, CAST(sessions AS BIGINT) AS sessions,
  {R('(sessions - MIN(sessions) OVER ()) / NULLIF(MAX(sessions) OVER () - MIN(sessions) OVER (), 0) * 100')} AS sessions_norm
FROM d""", ["web_daily"])
def w09(t):
    d = ad.web_daily(t).groupBy("date_day").agg(F.sum("sessions").alias("sessions"))
    return W.minmax_normalize(d, "sessions")


# fixed values: the funnel steps (event type, display name) in order
FUNNEL = (("view", "Landing"), ("click", "Engagement"), ("signup", "Signup"), ("purchase", "Purchase"))


def _funnel_users(t):
    e = t.events.select("event_type", "user_id").where(F.col("event_type").isin([s for s, _ in FUNNEL]))
    step = F.lit(None)
    name = F.lit(None)
    for i, (et, nm) in reversed(list(enumerate(FUNNEL))):
        step = F.when(F.col("event_type") == et, F.lit(i + 1)).otherwise(step)
        name = F.when(F.col("event_type") == et, F.lit(nm)).otherwise(name)
    return e.groupBy(step.alias("step"), name.alias("name")).agg(F.countDistinct("user_id").alias("users"))


_FUNNEL_SQL = "steps AS (SELECT CASE event_type " + " ".join(
    f"WHEN '{et}' THEN {i + 1}" for i, (et, _) in enumerate(FUNNEL)) + " END AS step, CASE event_type " + " ".join(
    f"WHEN '{et}' THEN '{nm}'" for et, nm in FUNNEL) + " END AS name, COUNT(DISTINCT user_id) AS users FROM events WHERE event_type IN (" + ", ".join(
    f"'{et}'" for et, _ in FUNNEL) + ") GROUP BY 1, 2)"


@register("w10_funnel_steps", f"""
WITH {_FUNNEL_SQL}
SELECT step, name, users,
  {R('CASE WHEN LAG(users) OVER (ORDER BY step) IS NULL THEN NULL WHEN LAG(users) OVER (ORDER BY step) > 0 THEN users / LAG(users) OVER (ORDER BY step) * 100 ELSE 0.0 END')} AS conversion_rate,
  {R('CASE WHEN LAG(users) OVER (ORDER BY step) IS NULL THEN NULL WHEN LAG(users) OVER (ORDER BY step) > 0 THEN 100 - users / LAG(users) OVER (ORDER BY step) * 100 ELSE 0.0 END')} AS dropoff_rate
FROM steps""")
def w10(t):
    return W.funnel_steps(_funnel_users(t))


@register("w10_biggest_dropoff", f"""
WITH {_FUNNEL_SQL},
f AS (SELECT step, name, CASE WHEN LAG(users) OVER (ORDER BY step) > 0 THEN 100 - users / LAG(users) OVER (ORDER BY step) * 100
  WHEN LAG(users) OVER (ORDER BY step) IS NOT NULL THEN 0.0 END AS d FROM steps),
b AS (SELECT * FROM f WHERE d IS NOT NULL ORDER BY d DESC, step LIMIT 1)
SELECT name AS step_name, {R('d')} AS dropoff_rate,
  CASE WHEN d > 70 THEN 'critical' WHEN d > 50 THEN 'high' ELSE 'none' END AS severity FROM b""")
def w10b(t):
    return W.biggest_dropoff(W.funnel_steps(_funnel_users(t)))


_A13_STEPS = """a13 AS (
  WITH s AS (SELECT SUM(sessions) AS sessions, AVG(bounce_rate) AS b FROM web_daily),
  p AS (SELECT COUNT(DISTINCT CAST(date_day AS VARCHAR) || '-' || pagePath) AS page_views FROM web_pages)
  SELECT CAST(COALESCE(sessions, 0) AS BIGINT) AS sessions, COALESCE(page_views, 0) AS page_views,
    CAST(floor(COALESCE(sessions, 0) * CASE WHEN b IS NULL OR b = 0 THEN 0.5 ELSE 1.0 - b END) AS BIGINT) AS engaged_sessions,
    CAST(0 AS BIGINT) AS conversions FROM s, p),
steps AS (SELECT 1 AS step, 'Session Started' AS name, sessions AS users FROM a13
  UNION ALL SELECT 2, 'Content Viewed', page_views FROM a13
  UNION ALL SELECT 3, 'Engaged (CTA Click)', engaged_sessions FROM a13
  UNION ALL SELECT 4, 'Conversion', conversions FROM a13)"""


def _web_funnel(t):
    return A.funnel_steps_from_counts(A.funnel_counts(ad.web_daily(t), ad.web_pages(t)))


@register("w10_web_funnel", f"""
WITH {_A13_STEPS}
SELECT step, name, users,
  {R('CASE WHEN LAG(users) OVER (ORDER BY step) IS NULL THEN NULL WHEN LAG(users) OVER (ORDER BY step) > 0 THEN users / LAG(users) OVER (ORDER BY step) * 100 ELSE 0.0 END')} AS conversion_rate,
  {R('CASE WHEN LAG(users) OVER (ORDER BY step) IS NULL THEN NULL WHEN LAG(users) OVER (ORDER BY step) > 0 THEN 100 - users / LAG(users) OVER (ORDER BY step) * 100 ELSE 0.0 END')} AS dropoff_rate
FROM steps""", ["web_daily", "web_pages"])
def w10w(t):
    return W.funnel_steps(_web_funnel(t))


@register("w10_web_funnel_biggest_dropoff", f"""
WITH {_A13_STEPS},
f AS (SELECT step, name, CASE WHEN LAG(users) OVER (ORDER BY step) > 0 THEN 100 - users / LAG(users) OVER (ORDER BY step) * 100
  WHEN LAG(users) OVER (ORDER BY step) IS NOT NULL THEN 0.0 END AS d FROM steps),
b AS (SELECT * FROM f WHERE d IS NOT NULL ORDER BY d DESC, step LIMIT 1)
SELECT name AS step_name, {R('d')} AS dropoff_rate,
  CASE WHEN d > 70 THEN 'critical' WHEN d > 50 THEN 'high' ELSE 'none' END AS severity FROM b""", ["web_daily", "web_pages"])
def w10wb(t):
    return W.biggest_dropoff(W.funnel_steps(_web_funnel(t)))


@register("w12_platform_share", f"""
WITH g AS (SELECT platform, SUM(spend) AS spend FROM ads_lean GROUP BY 1)
SELECT platform, {R('spend')} AS spend, {R('spend * 100 / NULLIF(SUM(spend) OVER (), 0)')} AS spend_share FROM g""", ["ads_lean"])
def w12(t):
    g = ad.ads(t, dims=False).groupBy("platform").agg(F.sum("spend").alias("spend"))
    return W.share_of_total(g, "spend")


@register("n08_forecast", f"""
WITH d AS (SELECT date_day, SUM(conversions) AS conversions FROM ads_lean WHERE {_G} GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date_day DESC) AS rd, COUNT(*) OVER () AS n,
  CASE WHEN COUNT(*) OVER w7 = 7 THEN AVG(conversions) OVER w7 END AS ma7 FROM d
  WINDOW w7 AS (ORDER BY date_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
g AS (SELECT MAX(n) AS n, MAX(date_day) AS last_date, MAX(CASE WHEN rd = 1 THEN ma7 END) AS ma7_last,
  REGR_SLOPE(CASE WHEN rd <= 14 THEN conversions END, CASE WHEN rd <= 14 AND conversions IS NOT NULL THEN CAST(14 - rd AS DOUBLE) END) AS s,
  COUNT(CASE WHEN rd <= 14 THEN conversions END) AS fit_n, STDDEV_SAMP(conversions) AS std_dev FROM r),
h AS (SELECT *, CASE WHEN fit_n >= 7 THEN COALESCE(s, 0.0) ELSE 0.0 END AS slope, UNNEST(range(1, 15)) AS i FROM g WHERE n >= 14),
f AS (SELECT *, GREATEST(0.0, ma7_last + slope * i) AS forecast FROM h)
SELECT {R('ma7_last')} AS ma7_last, {R('std_dev')} AS std_dev, {R('slope')} AS slope, CAST(i AS INTEGER) AS i,
  {DS('CAST(last_date + CAST(i AS INTEGER) AS DATE)')} AS forecast_date, {R('forecast')} AS forecast,
  {R('GREATEST(0.0, forecast - 1.96 * std_dev)')} AS lower, {R('forecast + 1.96 * std_dev')} AS upper,
  {R('SUM(forecast) OVER ()')} AS total_forecast,
  CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'stable' END AS direction,
  {R('CASE WHEN ma7_last > 0 THEN slope / ma7_last * 100 ELSE 0.0 END')} AS daily_trend_pct
FROM f""", ["ads_lean"])
def n08(t):
    d = _google(t, dims=False).groupBy("date_day").agg(F.sum("conversions").alias("conversions"))
    return W.linear_forecast(d, "conversions", horizon=14)


# ------------------------------------------------------------------------ scores
_TOP20_TRAFFIC = f"""top AS (SELECT sessionSource AS source, sessionMedium AS medium, SUM(sessions) AS sessions,
  SUM(totalUsers) AS users, SUM(newUsers) AS new_users, AVG(bounceRate) AS bounce_rate, SUM(screenPageViews) AS page_views
  FROM web_traffic WHERE sessionSource IS NOT NULL AND sessionMedium IS NOT NULL
  GROUP BY 1, 2 ORDER BY sessions DESC, source, medium LIMIT 20)"""


@register("n01_traffic_quality", f"""
WITH {_TOP20_TRAFFIC},
s AS (SELECT *, 1.0 - bounce_rate AS engagement_rate, page_views / NULLIF(sessions, 0) AS pages_per_session,
  quantile_cont(sessions, 0.75) OVER () AS p75 FROM top),
q AS (SELECT *, LEAST(engagement_rate * pages_per_session * 20, 100.0) AS quality_score FROM s)
SELECT source, medium, CAST(sessions AS BIGINT) AS sessions, CAST(users AS BIGINT) AS users,
  CAST(new_users AS BIGINT) AS new_users, {R('bounce_rate')} AS bounce_rate, CAST(page_views AS BIGINT) AS page_views,
  {R('engagement_rate')} AS engagement_rate, {R('pages_per_session')} AS pages_per_session,
  {R('quality_score')} AS quality_score,
  CASE WHEN sessions > p75 AND quality_score > 50 THEN 'Winner' WHEN sessions > p75 AND quality_score > 30 THEN 'Monitor'
    WHEN sessions > p75 THEN 'Junk' WHEN quality_score > 60 THEN 'Scale' ELSE 'Standard' END AS insight
FROM q""", ["web_traffic"])
def n01(t):
    top = top_k(A.traffic_by_source(ad.web_traffic(t)), [F.desc("sessions"), "source", "medium"], 20)
    return N.traffic_quality(top)


_TOP20_CAMPAIGNS = f"""g AS (SELECT campaign_name, campaign_type, CAST(SUM(impressions) AS BIGINT) AS impressions,
    CAST(SUM(clicks) AS BIGINT) AS clicks, SUM(spend) AS cost, SUM(conversions) AS conversions,
    SUM(COALESCE(conversion_value, 0)) AS conversion_value, AVG(clicks / NULLIF(impressions, 0)) AS avg_ctr
  FROM ads WHERE {_G} GROUP BY 1, 2),
top AS (SELECT *, COALESCE(clicks / NULLIF(impressions, 0), 0.0) AS ctr, COALESCE(conversions / NULLIF(clicks, 0), 0.0) AS conv_rate,
  cost / NULLIF(conversions, 0) AS cpa, COALESCE(cost / NULLIF(clicks, 0), 0.0) AS cpc,
  COALESCE(conversion_value / NULLIF(cost, 0), 0.0) AS roas
  FROM g ORDER BY cost DESC, campaign_name, campaign_type LIMIT 20),
a AS (SELECT *, CASE WHEN AVG(conv_rate) OVER () > 0 THEN AVG(conv_rate) OVER () ELSE 0.01 END AS avg_conv_rate,
  CASE WHEN AVG(avg_ctr) OVER () > 0 THEN AVG(avg_ctr) OVER () ELSE 0.01 END AS avg_ctr_set,
  CASE WHEN AVG(roas) OVER () > 0 THEN AVG(roas) OVER () ELSE 1.0 END AS avg_roas,
  COALESCE(AVG(CASE WHEN cpa > 0 THEN cpa END) OVER (), 1.0) AS avg_cpa FROM top),
sc AS (SELECT *, CAST(LEAST(round_even(CAST(
    LEAST(conv_rate / avg_conv_rate, 2.0) * 15
    + CASE WHEN COALESCE(avg_ctr, 0) <> 0 THEN LEAST(avg_ctr / avg_ctr_set, 2.0) * 10 ELSE 0.0 END
    + CASE WHEN COALESCE(roas, 0) <> 0 THEN LEAST(roas / avg_roas, 2.0) * 15 ELSE 0.0 END
    + CASE WHEN cpa > 0 AND avg_cpa > 0 THEN LEAST(avg_cpa / cpa, 2.0) * 10 ELSE 0.0 END
  AS DECIMAL(38,9)), 0), 100) AS BIGINT) AS efficiency_score FROM a)"""

_N02_COLS = f"""campaign_name, campaign_type, impressions, clicks, {R('cost')} AS cost, {R('conversions')} AS conversions,
  {R('conversion_value')} AS conversion_value, {R('avg_ctr')} AS avg_ctr, {R('ctr')} AS ctr, {R('conv_rate')} AS conv_rate,
  {R('cpa')} AS cpa, {R('cpc')} AS cpc, {R('roas')} AS roas, {R('avg_conv_rate')} AS avg_conv_rate,
  {R('avg_ctr_set')} AS avg_ctr_set, {R('avg_roas')} AS avg_roas, {R('avg_cpa')} AS avg_cpa, efficiency_score,
  CASE WHEN efficiency_score >= 80 THEN 'A' WHEN efficiency_score >= 60 THEN 'B' WHEN efficiency_score >= 40 THEN 'C'
    WHEN efficiency_score >= 20 THEN 'D' ELSE 'F' END AS grade"""


def _n02(t):
    top = top_k(A.campaign_performance(_google(t)), [F.desc("cost"), "campaign_name", "campaign_type"], 20)
    return N.campaign_efficiency(top)


@register("n02_campaign_efficiency", f"WITH {_TOP20_CAMPAIGNS} SELECT {_N02_COLS} FROM sc", ["ads"])
def n02(t):
    return _n02(t)


@register("t09_needs_attention", f"""
WITH {_TOP20_CAMPAIGNS},
f AS (SELECT *, quantile_cont(cost, 0.25) OVER () AS p25 FROM sc),
x AS (SELECT *, list_filter([CASE WHEN conv_rate < avg_conv_rate * 0.5 THEN 'low conv rate' END,
    CASE WHEN cpa > avg_cpa * 1.5 THEN 'high CPA' END, CASE WHEN roas < avg_roas * 0.5 THEN 'low ROAS' END], lambda x: x IS NOT NULL) AS tags
  FROM f WHERE cost > p25 AND efficiency_score < 40)
SELECT {_N02_COLS}, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'underperforming' END AS issues
FROM x ORDER BY efficiency_score, campaign_name LIMIT 3""", ["ads"])
def t09(t):
    from mkpulse.operators.topk import needs_attention

    return needs_attention(_n02(t))


@register("t09_needs_attention_score55", f"""
WITH {_TOP20_CAMPAIGNS},
f AS (SELECT *, quantile_cont(cost, 0.25) OVER () AS p25 FROM sc),
x AS (SELECT *, list_filter([CASE WHEN conv_rate < avg_conv_rate * 0.5 THEN 'low conv rate' END,
    CASE WHEN cpa > avg_cpa * 1.5 THEN 'high CPA' END, CASE WHEN roas < avg_roas * 0.5 THEN 'low ROAS' END], lambda x: x IS NOT NULL) AS tags
  FROM f WHERE cost > p25 AND efficiency_score < 55)
SELECT {_N02_COLS}, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'underperforming' END AS issues
FROM x ORDER BY efficiency_score, campaign_name LIMIT 3""", ["ads"])
def t09b(t):
    from mkpulse.operators.topk import needs_attention

    return needs_attention(_n02(t), score_max=55.0)


#: One "campaign" per campaign and day: small numbers, so that the scores spread over all grades.
_ADS_BY_DAY = "ads_day AS (SELECT * REPLACE (campaign_name || '/' || CAST(date_day AS VARCHAR) AS campaign_name) FROM ads)"
_TOP20_CAMPAIGN_DAYS = f"{_ADS_BY_DAY},\n" + _TOP20_CAMPAIGNS.replace("FROM ads WHERE", "FROM ads_day WHERE")


def _n02_days(t):
    ads = _google(t).withColumn("campaign_name", F.concat_ws("/", "campaign_name", F.col("date_day").cast("string")))
    return N.campaign_efficiency(top_k(A.campaign_performance(ads), [F.desc("cost"), "campaign_name", "campaign_type"], 20))


@register("n02_campaign_day_efficiency", f"WITH {_TOP20_CAMPAIGN_DAYS} SELECT {_N02_COLS} FROM sc", ["ads"])
def n02_days(t):
    return _n02_days(t)


@register("t09_campaign_days_needing_attention", f"""
WITH {_TOP20_CAMPAIGN_DAYS},
f AS (SELECT *, quantile_cont(cost, 0.25) OVER () AS p25 FROM sc),
x AS (SELECT *, list_filter([CASE WHEN conv_rate < avg_conv_rate * 0.5 THEN 'low conv rate' END,
    CASE WHEN cpa > avg_cpa * 1.5 THEN 'high CPA' END, CASE WHEN roas < avg_roas * 0.5 THEN 'low ROAS' END], lambda x: x IS NOT NULL) AS tags
  FROM f WHERE cost > p25 AND efficiency_score < 40)
SELECT {_N02_COLS}, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'underperforming' END AS issues
FROM x ORDER BY efficiency_score, campaign_name LIMIT 3""", ["ads"])
def t09_days(t):
    from mkpulse.operators.topk import needs_attention

    return needs_attention(_n02_days(t))


_QUAD_IN = f"""qi AS (
  SELECT 'Google Ads' AS platform, campaign_name, SUM(spend) AS spend, CAST(SUM(clicks) AS BIGINT) AS clicks,
    CAST(SUM(impressions) AS BIGINT) AS impressions, SUM(conversions) AS conversions,
    CASE WHEN SUM(conversions) > 0 THEN SUM(spend) / SUM(conversions) END AS cpa
  FROM ads WHERE {_G} GROUP BY campaign_name HAVING SUM(spend) > 0
  UNION ALL
  SELECT 'Meta Ads', campaign_name, SUM(spend), CAST(SUM(clicks) AS BIGINT), CAST(SUM(impressions) AS BIGINT),
    CAST(SUM(COALESCE(app_installs, 0) + COALESCE(purchases, 0)) AS DOUBLE),
    CASE WHEN SUM(COALESCE(app_installs, 0) + COALESCE(purchases, 0)) > 0
      THEN SUM(spend) / SUM(COALESCE(app_installs, 0) + COALESCE(purchases, 0)) END
  FROM ads WHERE {_M} GROUP BY campaign_name HAVING SUM(spend) > 0),
q AS (SELECT *, median(spend) OVER () AS median_spend, median(cpa) OVER () AS median_cpa
  FROM qi WHERE conversions > 0 AND cpa IS NOT NULL),
ql AS (SELECT *, CASE WHEN spend >= median_spend AND cpa <= median_cpa THEN 'Stars'
    WHEN spend < median_spend AND cpa <= median_cpa THEN 'Question Marks'
    WHEN spend >= median_spend THEN 'Cash Cows' ELSE 'Dogs' END AS quadrant FROM q)"""


@register("n03_quadrants", f"""
WITH {_QUAD_IN}
SELECT platform, campaign_name, {R('spend')} AS spend, clicks, impressions, {R('conversions')} AS conversions,
  {R('cpa')} AS cpa, {R('median_spend')} AS median_spend, {R('median_cpa')} AS median_cpa, quadrant FROM ql""", ["ads"])
def n03(t):
    return N.campaign_quadrants(N.quadrant_inputs(ad.ads(t)))


@register("a45_quadrant_summary", f"""
WITH {_QUAD_IN}
SELECT quadrant, COUNT(*) AS campaigns, {R('SUM(spend)')} AS spend, {R('SUM(conversions)')} AS conversions,
  {R('AVG(cpa)')} AS avg_cpa FROM ql GROUP BY quadrant""", ["ads"])
def a45(t):
    return A.quadrant_summary(N.campaign_quadrants(N.quadrant_inputs(ad.ads(t))))


_N04_SQL = f"""
WITH g AS (SELECT campaign_name, campaign_type, SUM(spend) AS cost, SUM(conversions) AS conversions,
    CAST(SUM(clicks) AS BIGINT) AS clicks FROM ads WHERE {_G} GROUP BY 1, 2 HAVING SUM(spend) > 0),
e AS (SELECT *, conversions / NULLIF(cost, 0) AS efficiency, cost / NULLIF(conversions, 0) AS cpa FROM g),
r AS (SELECT *, CASE WHEN AVG(efficiency) OVER () > 0 THEN efficiency / AVG(efficiency) OVER () ELSE 1.0 END AS efficiency_ratio FROM e),
c AS (SELECT *, CASE WHEN efficiency_ratio > 1 THEN LEAST(50.0, (efficiency_ratio - 1) * 40)
    ELSE GREATEST(-50.0, (efficiency_ratio - 1) * 40) END AS budget_change_pct FROM r),
b AS (SELECT *, cost * (1 + budget_change_pct / 100) AS recommended_budget FROM c),
n AS (SELECT *, recommended_budget * SUM(cost) OVER () / SUM(recommended_budget) OVER () AS rbn FROM b)
SELECT campaign_name, campaign_type, {R('cost')} AS cost, {R('conversions')} AS conversions, clicks,
  {R('efficiency')} AS efficiency, {R('cpa')} AS cpa, {R('efficiency_ratio')} AS efficiency_ratio,
  CASE WHEN efficiency_ratio > 1.5 THEN 'Scale' WHEN efficiency_ratio > 0.8 THEN 'Maintain'
    WHEN efficiency_ratio > 0.5 THEN 'Reduce' ELSE 'Pause' END AS recommendation,
  {R('budget_change_pct')} AS budget_change_pct, {R('recommended_budget')} AS recommended_budget,
  {R('rbn')} AS recommended_budget_normalized, {R('rbn - cost')} AS budget_delta
FROM n"""


@register("n04_budget_optimizer", _N04_SQL, ["ads"])
def n04(t):
    g = _google(t).groupBy("campaign_name", "campaign_type").agg(
        F.sum("spend").alias("cost"), F.sum("conversions").alias("conversions"), F.sum("clicks").alias("clicks")
    )
    return N.budget_optimizer(g)


@register("n04_campaign_day_budgets", f"WITH {_ADS_BY_DAY}," + _N04_SQL.replace("WITH g AS", "g AS", 1).replace("FROM ads WHERE", "FROM ads_day WHERE"), ["ads"])
def n04_days(t):
    """Every campaign and day with a budget of its own: all four classes occur."""
    g = _google(t).groupBy(F.concat_ws("/", "campaign_name", F.col("date_day").cast("string")).alias("campaign_name"), "campaign_type").agg(
        F.sum("spend").alias("cost"), F.sum("conversions").alias("conversions"), F.sum("clicks").alias("clicks"))
    return N.budget_optimizer(g)


# five names for the 25 campaign ids: campaigns of one name are apart by their id
_FATIGUE_SQL = f"""d AS (SELECT date_day, campaign_name AS campaign_id, 'Group ' || right(campaign_name, 1) AS campaign_name,
  SUM(spend) AS spend, AVG(frequency) AS frequency, AVG(ctr) AS ctr
  FROM ads WHERE {_M} GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY campaign_id ORDER BY date_day) AS rn,
  COUNT(*) OVER (PARTITION BY campaign_id) AS n FROM d),
g AS (SELECT campaign_id, MAX(campaign_name) AS campaign_name, COUNT(*) AS days_running, AVG(frequency) AS avg_frequency, SUM(spend) AS total_spend,
  AVG(CASE WHEN rn <= n // 2 THEN ctr END) AS c1, AVG(CASE WHEN rn > n // 2 THEN ctr END) AS c2 FROM r
  GROUP BY campaign_id HAVING COUNT(*) >= 3),
s AS (SELECT *, CASE WHEN c1 > 0 THEN (c1 - c2) / c1 * 100 ELSE 0.0 END AS ctr_decline_pct FROM g),
f AS (SELECT *, CASE WHEN ctr_decline_pct > 0 THEN LEAST(ctr_decline_pct * 2, 40.0) ELSE 0.0 END
  + CASE WHEN avg_frequency > 2 THEN LEAST((avg_frequency - 2) * 10, 30.0) ELSE 0.0 END
  + CASE WHEN days_running > 14 THEN LEAST((days_running - 14) * 2.0, 30.0) ELSE 0.0 END AS fatigue_score FROM s),
st AS (SELECT *, CASE WHEN fatigue_score >= 60 THEN 'High Fatigue' WHEN fatigue_score >= 30 THEN 'Moderate' ELSE 'Healthy' END AS status FROM f)"""


def _fatigue(t):
    d = _meta(t).groupBy("date_day", F.col("campaign_name").alias("campaign_id")).agg(
        F.sum("spend").alias("spend"), F.avg("frequency").alias("frequency"), F.avg("ctr").alias("ctr")
    )
    return N.creative_fatigue(d.withColumn("campaign_name", F.concat(F.lit("Group "), F.expr("right(campaign_id, 1)"))))


@register("n05_creative_fatigue", f"""
WITH {_FATIGUE_SQL}
SELECT campaign_id, campaign_name, days_running, {R('avg_frequency')} AS avg_frequency, {R('total_spend')} AS total_spend,
  {R('ctr_decline_pct')} AS ctr_decline_pct, {R('fatigue_score')} AS fatigue_score, status FROM st""", ["ads"])
def n05(t):
    return _fatigue(t)


@register("n05_fatigue_counts", f"""
WITH {_FATIGUE_SQL}
SELECT COUNT(CASE WHEN status = 'High Fatigue' THEN 1 END) AS high, COUNT(CASE WHEN status = 'Moderate' THEN 1 END) AS moderate,
  COUNT(CASE WHEN status = 'Healthy' THEN 1 END) AS healthy FROM st""", ["ads"])
def n05c(t):
    return N.fatigue_counts(_fatigue(t))


@register("n06_daypart_heatmap", f"""
SELECT CAST(isodow(date_day) - 1 AS INTEGER) AS day_num, hour, CAST(SUM(clicks) AS BIGINT) AS clicks,
  {R('SUM(conversions)')} AS conversions, {R('SUM(cost)')} AS cost, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('SUM(conversions) / NULLIF(SUM(cost), 0)')} AS efficiency
FROM hourly GROUP BY 1, 2""", ["hourly"])
def n06(t):
    return N.daypart_heatmap(ad.hourly(t))


@register("n06_daypart_matrix", "SELECT CAST(isodow(date_day) - 1 AS INTEGER) AS day_num, " + ", ".join(
    R(f"COALESCE(SUM(CASE WHEN hour = {h} THEN conversions END), 0.0)") + f" AS h{h:02d}" for h in range(24)
) + " FROM hourly GROUP BY 1", ["hourly"])
def n06m(t):
    return N.daypart_matrix(ad.hourly(t))


@register("n06_best_worst_hours", f"""
WITH g AS (SELECT hour, SUM(conversions) AS conversions, SUM(cost) AS cost, CAST(SUM(clicks) AS BIGINT) AS clicks,
  SUM(conversions) / NULLIF(SUM(cost), 0) AS efficiency FROM hourly GROUP BY hour),
e AS (SELECT * FROM g WHERE efficiency IS NOT NULL),
b AS (SELECT *, 'best' AS side FROM e ORDER BY efficiency DESC, hour LIMIT 5),
w AS (SELECT *, 'worst' AS side FROM (SELECT * FROM e ORDER BY efficiency, hour LIMIT 5) WHERE efficiency > 0)
SELECT hour, {R('conversions')} AS conversions, {R('cost')} AS cost, clicks, {R('efficiency')} AS efficiency, side
FROM (SELECT * FROM b UNION ALL SELECT * FROM w)""", ["hourly"])
def n06b(t):
    return N.best_worst_hours(ad.hourly(t))


def _keywords(t):
    return ad.organic(t).groupBy(F.col("query").alias("keyword")).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("ctr"),
        F.avg("position").alias("position"),
    ).where(F.col("impressions") >= 10)


def _clustered(keywords, by=None):
    return N.fit_keyword_clusters(keywords, by=by).assign(keywords)


def _clusters_sql(source: str, features: tuple[str, ...], part: str = "0") -> str:
    """CTEs that fit and assign: ``kw`` (the keywords) gets ``cluster`` in ``clu``; one fit for each value of ``part``."""
    cols, n, k = ", ".join(features), len(features), 5
    z = ", ".join(f"CAST(CASE WHEN s{j} > 0 THEN round((CAST({c} AS DOUBLE) - m{j}) / s{j} * {N.GRID}) ELSE 0 END AS BIGINT)" for j, c in enumerate(features))
    stats = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m{j}, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS s{j}" for j, c in enumerate(features))
    there = " AND ".join(f"{c} IS NOT NULL" for c in features)
    far = " + ".join(f"(x.z[{j}] - c.z[{j}]) * (x.z[{j}] - c.z[{j}])" for j in range(1, n + 1))
    move = ", ".join(f"CAST(floor(CAST(SUM(z[{j}]) AS DOUBLE) / COUNT(*)) AS BIGINT)" for j in range(1, n + 1))
    out = f"""kw AS ({source}), fit0 AS (SELECT *, {part} AS p, ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY impressions DESC, keyword) AS rk FROM kw WHERE {there}),
fit AS MATERIALIZED (SELECT p, keyword, {cols} FROM fit0 WHERE rk <= {N.FIT_ROWS}),
sca AS MATERIALIZED (SELECT p, {stats} FROM fit GROUP BY p HAVING COUNT(*) >= 10),
pts AS MATERIALIZED (SELECT p, keyword, [{z}] AS z FROM fit JOIN sca USING (p)),
c0 AS MATERIALIZED (SELECT p, s, CAST(rk - 1 AS INTEGER) AS c, z FROM (SELECT p, s, z,
    ROW_NUMBER() OVER (PARTITION BY p, s ORDER BY md5(CAST(s AS VARCHAR) || ':' || keyword), keyword) AS rk
  FROM pts, (SELECT UNNEST(range({N.STARTS})) AS s)) WHERE rk <= {k}),
"""
    for r in range(N.LLOYD_ROUNDS):
        out += f"""a{r} AS MATERIALIZED (SELECT p, s, z, arg_min(c, struct_pack(d := d, c := c)) AS c
  FROM (SELECT c.p, c.s, x.keyword, x.z, c.c, {far} AS d FROM pts x JOIN c{r} c ON x.p = c.p) GROUP BY p, s, keyword, z),
c{r + 1} AS MATERIALIZED (SELECT p, s, c, COALESCE(g.z, o.z) AS z FROM c{r} o LEFT JOIN (SELECT p, s, c, [{move}] AS z FROM a{r} GROUP BY p, s, c) g USING (p, s, c)),
"""
    last = f"c{N.LLOYD_ROUNDS}"
    return out + f"""cost AS (SELECT p, s, SUM(d) AS d FROM (SELECT c.p, c.s, x.keyword, MIN({far}) AS d FROM pts x JOIN {last} c ON x.p = c.p GROUP BY c.p, c.s, x.keyword)
  GROUP BY p, s),
cen AS MATERIALIZED (SELECT p, c, z FROM {last} JOIN (SELECT p, arg_min(s, struct_pack(d := d, s := s)) AS s FROM cost GROUP BY p) USING (p, s)),
al0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS rid, kw.*, {part} AS p FROM kw),
al1 AS (SELECT rid, p, [{z}] AS z FROM al0 JOIN sca USING (p) WHERE {there}),
asg AS (SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS cluster FROM (SELECT x.rid, c.c, {far} AS d FROM al1 x JOIN cen c ON x.p = c.p) GROUP BY rid),
clu AS (SELECT al0.* EXCLUDE (rid, p), cluster FROM al0 LEFT JOIN asg USING (rid))"""


_FEATURES = ("clicks", "impressions", "ctr", "position")
_KW_SQL = """SELECT query AS keyword, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions, AVG(ctr) AS ctr,
  AVG(position) AS position FROM organic GROUP BY 1 HAVING SUM(impressions) >= 10"""
_KW_DEVICE_SQL = _KW_SQL.replace("SELECT query AS keyword", "SELECT device, query AS keyword").replace("GROUP BY 1 HAVING", "GROUP BY 1, 2 HAVING")
_KW_PAID_SQL = f"""SELECT keyword_text AS keyword, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr FROM ads WHERE {_G} GROUP BY 1 HAVING SUM(impressions) > 0"""
_KW_OUT = f"keyword, clicks, impressions, {R('ctr')} AS ctr, {R('position')} AS position, CAST(cluster AS INTEGER) AS cluster"


@register("n07_keyword_clusters", f"WITH {_clusters_sql(_KW_SQL, _FEATURES)} SELECT {_KW_OUT} FROM clu", ["organic"])
def n07(t):
    return _clustered(_keywords(t)).drop("pca_x", "pca_y")


@register("n07_keyword_projection")
def n07_xy(t):
    """The two principal components of every keyword: SQL has no eigenvectors, a test holds them against numpy."""
    return _clustered(_keywords(t)).select("keyword", "cluster", "pca_x", "pca_y")


@register("n07_cluster_summary", f"""WITH {_clusters_sql(_KW_SQL, _FEATURES)}
SELECT CAST(cluster AS INTEGER) AS cluster, COUNT(*) AS keywords, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  {R('AVG(ctr)')} AS avg_ctr FROM clu GROUP BY cluster""", ["organic"])
def n07s(t):
    return N.cluster_summary(_clustered(_keywords(t)))


@register("n07_cluster_top_keywords", f"""WITH {_clusters_sql(_KW_SQL, _FEATURES)}
SELECT {_KW_OUT} FROM clu WHERE cluster IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY clicks DESC, keyword) <= 15""", ["organic"])
def n07_top(t):
    return N.cluster_top_keywords(_clustered(_keywords(t))).drop("pca_x", "pca_y")


@register("n07_paid_keyword_clusters", f"""WITH {_clusters_sql(_KW_PAID_SQL, _FEATURES[:3])}
SELECT keyword, clicks, impressions, {R('ctr')} AS ctr, CAST(cluster AS INTEGER) AS cluster FROM clu""", ["ads"])
def n07_paid(t):
    g = _google(t).groupBy(F.col("keyword_text").alias("keyword")).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        (F.sum("clicks") / F.nullif(F.sum("impressions"), F.lit(0))).alias("ctr")).where(F.col("impressions") > 0)
    return _clustered(g).drop("pca_x", "pca_y")


@register("n07_keyword_clusters_by_device", f"WITH {_clusters_sql(_KW_DEVICE_SQL, _FEATURES, 'device')} SELECT device, {_KW_OUT} FROM clu", ["organic"])
def n07d(t):
    g = ad.organic(t).groupBy("device", F.col("query").alias("keyword")).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("ctr"),
        F.avg("position").alias("position"),
    ).where(F.col("impressions") >= 10)
    return _clustered(g, by="device").drop("pca_x", "pca_y")


@register("n09_cannibalization", f"""
WITH {_J02_CTE}
SELECT keyword, CAST(organic_clicks AS BIGINT) AS organic_clicks, {R('avg_position')} AS avg_position,
  CAST(paid_clicks AS BIGINT) AS paid_clicks, {R('paid_spend')} AS paid_spend, {R('paid_conversions')} AS paid_conversions,
  CASE WHEN avg_position <= 3 THEN 'High' WHEN avg_position <= 5 THEN 'Medium' ELSE 'Low' END AS risk
FROM j""", ["organic", "ads"])
def n09(t):
    return N.cannibalization(J.seo_ppc_overlap(ad.organic(t), _google(t)))


@register("n09_cannibalization_summary", f"""
WITH {_J02_CTE}
SELECT COUNT(*) AS overlapping_keywords, {R('COALESCE(SUM(paid_spend), 0.0)')} AS overlap_spend,
  {R('COALESCE(SUM(CASE WHEN avg_position <= 3 THEN paid_spend END), 0.0)')} AS potential_savings,
  COUNT(CASE WHEN avg_position <= 3 THEN 1 END) AS high_risk_keywords
FROM j""", ["organic", "ads"])
def n09s(t):
    return N.cannibalization_summary(J.seo_ppc_overlap(ad.organic(t), _google(t)))


_KW_ROWS = f"""kw AS (SELECT keyword_text, keyword_match_type, campaign_name, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(clicks) AS BIGINT) AS clicks, SUM(spend) AS cost, SUM(conversions) AS conversions,
  SUM(COALESCE(conversion_value, 0)) AS conversion_value,
  COALESCE(SUM(conversions) / NULLIF(SUM(clicks), 0), 0.0) * 100 AS conv_rate,
  SUM(spend) / NULLIF(SUM(conversions), 0) AS cpa
  FROM ads WHERE {_G} GROUP BY 1, 2, 3 HAVING SUM(impressions) > 0)"""
_KW_COLS = f"""keyword_text, keyword_match_type, campaign_name, impressions, clicks, {R('cost')} AS cost,
  {R('conversions')} AS conversions, {R('conversion_value')} AS conversion_value, {R('conv_rate')} AS conv_rate, {R('cpa')} AS cpa"""


@register("n10_wasted_spend", f"""
WITH {_KW_ROWS},
w AS (SELECT *, SUM(cost) OVER () AS total_wasted, COUNT(*) OVER () AS wasted_keywords FROM kw
  WHERE cost > 0 AND (conversions = 0 OR conversions IS NULL))
SELECT {_KW_COLS}, {R('total_wasted')} AS total_wasted, wasted_keywords FROM w
ORDER BY cost DESC, keyword_text, keyword_match_type, campaign_name LIMIT 15""", ["ads"])
def n10(t):
    return N.wasted_spend(A.keyword_campaign(_google(t)))


@register("n10_opportunities", f"""
WITH {_KW_ROWS},
s AS (SELECT *, median(CASE WHEN cost > 0 THEN cost END) OVER () AS med,
  SUM(CASE WHEN conversions > 0 THEN cost END) OVER () / NULLIF(SUM(conversions) OVER (), 0) AS mcpa FROM kw)
SELECT {_KW_COLS} FROM s WHERE conversions > 0 AND cost / conversions <= mcpa AND cost < med
ORDER BY conv_rate DESC, keyword_text, keyword_match_type, campaign_name LIMIT 15""", ["ads"])
def n10o(t):
    return N.keyword_opportunities(A.keyword_campaign(_google(t)))


@register("n13_page_opportunity", f"""
WITH top AS (SELECT pagePath AS page_path, pageTitle AS page_title, CAST(SUM(screenPageViews) AS BIGINT) AS page_views,
  CAST(SUM(sessions) AS BIGINT) AS sessions, AVG(bounceRate) AS bounce_rate, AVG(averageSessionDuration) AS avg_duration
  FROM web_pages WHERE pagePath IS NOT NULL GROUP BY 1, 2 ORDER BY sessions DESC, page_path, page_title LIMIT 25),
s AS (SELECT *, 1.0 - bounce_rate AS engagement_rate FROM top),
o AS (SELECT *, sessions * (AVG(engagement_rate) OVER () - engagement_rate) AS opportunity_score FROM s)
SELECT page_path, page_title, page_views, sessions, {R('bounce_rate')} AS bounce_rate, {R('avg_duration')} AS avg_duration,
  {R('engagement_rate')} AS engagement_rate, {R('opportunity_score')} AS opportunity_score
FROM o WHERE opportunity_score > 0 ORDER BY opportunity_score DESC, page_path, page_title LIMIT 10""", ["web_pages"])
def n13(t):
    top = top_k(A.landing_pages(ad.web_pages(t)), [F.desc("sessions"), "page_path", "page_title"], 25)
    return N.page_opportunity(top)
