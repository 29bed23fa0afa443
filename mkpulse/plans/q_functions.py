"""Registered queries: scalar functions F01-F14, period filters P03-P12,
ordering / set operators T02-T08 and the S17 fallback join."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse import functions as FN
from mkpulse.functions import periods as P
from mkpulse.operators import aggregates as A
from mkpulse.operators import scoring as N
from mkpulse.operators import topk as T
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register
from mkpulse.plans.q_aggregates import LI_ASOF, _between
from mkpulse.sources import reports as S

INITCAP = ("array_to_string(list_transform(string_split(replace(lower({x}), '_', ' '), ' '), "
           "lambda w: upper(w[1]) || w[2:]), ' ')")


# ---------------------------------------------------------------- F01-F03
def _raw_numbers(t):
    e = t.events.select("event_id", "value", "props", "user_id")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.col("props"))
           .when(k == 3, F.concat(F.lit("-"), F.col("value").cast("string"))))
    return e.select("event_id", "user_id", "value", raw.alias("raw"))


@register("f01_f02_safe_casts", f"""
SELECT event_id,
  CAST(CASE event_id % 4 WHEN 0 THEN trunc(value) WHEN 3 THEN trunc(-value) ELSE 0 END AS BIGINT) AS as_int,
  {R('CASE event_id % 4 WHEN 0 THEN value WHEN 3 THEN -value ELSE 0.0 END')} AS as_float,
  {R('CASE event_id % 4 WHEN 0 THEN value WHEN 3 THEN -value END')} AS as_float_or_null
FROM events""")
def f01(t):
    r = _raw_numbers(t)
    return r.select("event_id", FN.safe_int("raw").alias("as_int"), FN.safe_float("raw").alias("as_float"),
                    FN.safe_float("raw", None).alias("as_float_or_null"))


@register("f03_safe_divide", f"""
SELECT event_id, {R('COALESCE(value / NULLIF(user_id % 3, 0), 0.0)')} AS ratio, {R('value / NULLIF(user_id % 3, 0)')} AS ratio_or_null
FROM events""")
def f03(t):
    e = t.events
    return e.select("event_id", FN.safe_divide("value", F.col("user_id") % 3).alias("ratio"),
                    FN.div("value", F.col("user_id") % 3).alias("ratio_or_null"))


@register("f04_pct_change", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) - 330 AS n FROM events GROUP BY 1),
l AS (SELECT *, LAG(n) OVER (ORDER BY d) AS p FROM d)
SELECT {DS('d')} AS d, n, CAST(p AS DOUBLE) AS p, {R('CASE WHEN p > 0 THEN (n - p) / p * 100 END')} AS pct_change,
  {R('CASE WHEN p <> 0 AND n IS NOT NULL THEN (n - p) / abs(p) * 100 END')} AS pct_change_abs
FROM l""")
def f04(t):
    from pyspark.sql import Window

    d = t.events.groupBy(F.to_date("ts").alias("d")).agg((F.count(F.lit(1)) - 330).alias("n"))
    d = d.withColumn("p", F.lag("n").over(Window.orderBy("d")))
    d = d.withColumn("pct_change", FN.pct_change("n", "p")).withColumn("pct_change_abs", FN.pct_change_abs("n", "p"))
    return d.withColumn("p", F.col("p").cast("double"))  # nullable count: compared as double


# ---------------------------------------------------------------- F05
@register("f05_to_day", f"""
SELECT event_id, {DS('CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(ts AS DATE) END')} AS day FROM events""")
def f05(t):
    e = t.events
    k = F.col("event_id") % 3
    s = (F.when(k == 0, F.date_format("ts", "yyyyMMdd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd"))
         .otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))))
    return e.select("event_id", FN.to_day(s).alias("day"))


# ---------------------------------------------------------------- F07
@register("f07_flatten", f"""
SELECT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS campaign_id, p_brand AS campaign_name,
  CASE WHEN p_size % 2 = 0 THEN 'ENABLED' ELSE 'PAUSED' END AS campaign_status, upper(p_type) AS campaign_advertising_channel_type,
  CASE WHEN l_linenumber <> 6 THEN CAST(p_size AS DOUBLE) END AS ad_group_id,
  CASE WHEN l_linenumber <> 6 THEN p_brand || '/' || CAST(p_size AS VARCHAR) END AS ad_group_name,
  CASE WHEN l_linenumber > 4 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'REMOVED' ELSE 'ENABLED' END AS ad_group_ad_status,
  CASE WHEN l_linenumber <= 4 THEN CAST(l_orderkey AS DOUBLE) END AS ad_group_ad_ad_id,
  CASE WHEN l_linenumber <= 4 THEN 'RESPONSIVE_SEARCH_AD' END AS ad_group_ad_ad_type,
  CASE WHEN l_linenumber <> 5 THEN CAST(p_partkey AS DOUBLE) END AS ad_group_criterion_criterion_id,
  CASE WHEN l_linenumber <> 5 THEN p_name END AS ad_group_criterion_keyword_text,
  CASE WHEN l_linenumber = 5 THEN NULL WHEN l_returnflag = 'A' THEN 'EXACT' WHEN l_returnflag = 'N' THEN 'PHRASE' ELSE 'BROAD' END
    AS ad_group_criterion_keyword_match_type,
  CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey % 30 + 2000 AS DOUBLE) END AS geographic_view_country_criterion_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 'LOCATION_OF_PRESENCE' END AS geographic_view_location_type,
  strftime(l_shipdate, '%Y-%m-%d') AS segments_date,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'MOBILE' WHEN l_linenumber % 3 = 1 THEN 'DESKTOP'
    ELSE 'TABLET' END AS segments_device,
  CASE WHEN l_discount >= 0.02 THEN 'purchase' END AS segments_conversion_action, CAST(l_orderkey % 24 AS INTEGER) AS segments_hour,
  CAST(l_quantity AS BIGINT) * 20 AS metrics_impressions,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS metrics_clicks,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(ROUND(l_extendedprice * 1000) AS DOUBLE) END AS metrics_cost_micros,
  {R('l_extendedprice * 1000 / l_quantity')} AS metrics_average_cpc,
  {R('CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END')} AS metrics_conversions,
  {R('CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END * l_extendedprice / 100')} AS metrics_conversions_value
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'""")
def f07(t):
    from mkpulse.plans.q_sources import _raw_search_ads

    flat = FN.flatten(_raw_search_ads(t))
    nullable = ("metrics_cost_micros", "ad_group_id", "ad_group_ad_ad_id", "ad_group_criterion_criterion_id",
                "geographic_view_country_criterion_id")  # compared as double (pandas: ints with NULLs are floats)
    return flat.select(*[F.col(c).cast("double").alias(c) if c in nullable else F.col(c) for c in flat.columns])


# ---------------------------------------------------------------- F08-F10, F13, F14
@register("f08_truncate_paths", """
SELECT page_id, CASE WHEN length(url) > 50 THEN '...' || right(url, 47) ELSE url END AS url_tail,
  CASE WHEN length(url) > 40 THEN string_split(url, '/')[-1] ELSE url END AS url_last,
  CASE WHEN length(url) > 40 THEN left(url, 40) || '...' ELSE url END AS url_head
FROM pages""")
def f08(t):
    p = t.pages.select("page_id", "url")
    return p.select("page_id", FN.truncate_tail("url").alias("url_tail"), FN.last_path_segment("url").alias("url_last"),
                    FN.truncate_head("url", 40).alias("url_head"))


@register("f09_humanize", "SELECT p_partkey, " + INITCAP.format(x="p_type || '_ads'") + " AS label FROM part")
def f09(t):
    return t.part.select("p_partkey", FN.humanize(F.concat(F.col("p_type"), F.lit("_ads"))).alias("label"))


@register("f10_concat_key", f"""
SELECT {DS('date_day')} AS date_day, sessionSource, sessionMedium,
  sessionSource || ' / ' || CASE WHEN sessionMedium = 'email' THEN NULL ELSE sessionMedium END AS source_medium
FROM web_traffic""", ["web_traffic"])
def f10(t):
    w = ad.web_traffic(t).select("date_day", "sessionSource", "sessionMedium")
    m = F.when(F.col("sessionMedium") != "email", F.col("sessionMedium"))
    return w.withColumn("source_medium", FN.concat_key("sessionSource", m))


@register("f13_weekday", f"""
SELECT {DS('date_day')} AS date_day, dayname(date_day) AS weekday, CAST(isodow(date_day) - 1 AS INTEGER) AS weekday_num,
  CAST(sessions AS BIGINT) AS sessions FROM web_daily""", ["web_daily"])
def f13(t):
    d = ad.web_daily(t)
    return d.select("date_day", FN.weekday_name("date_day").alias("weekday"), F.weekday("date_day").alias("weekday_num"), "sessions")


@register("f14_comma_join", """
SELECT c_custkey, concat_ws(',', n_name, r_name, c_mktsegment) AS labels
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def f14(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", FN.comma_join(F.array("n_name", "r_name", "c_mktsegment")).alias("labels"))


# ---------------------------------------------------------------- periods
_P90 = P.preset_range(LI_ASOF, 90)


def _google(t):
    return ad.ads(t, dims=False).where(F.col("platform") == "google_ads")


@register("p03_preset_window", f"""
SELECT {DS('date_day')} AS date_day, {R('SUM(spend)')} AS value FROM ads_lean
WHERE platform = 'google_ads' AND {_between('date_day', _P90)} GROUP BY date_day""", ["ads_lean"])
def p03(t):
    return A.daily_metric(P.filter_period(_google(t), "date_day", *_P90), "spend")


_P30 = P.preset_range(LI_ASOF, 30)
_KINDS = ("previous", "wow", "mom", "yoy")


def _p04_sql() -> str:
    parts = []
    for k in _KINDS:
        prev = P.comparison_range(*_P30, k)
        for period, rng in (("current", _P30), ("previous", prev)):
            parts.append(f"""SELECT '{k}' AS kind, '{period}' AS period, {R('SUM(spend)')} AS spend,
  CAST(SUM(clicks) AS BIGINT) AS clicks FROM ads_lean WHERE platform = 'google_ads' AND {_between('date_day', rng)}""")
    return "\nUNION ALL\n".join(parts)


@register("p04_comparison_periods", _p04_sql(), ["ads_lean"])
def p04(t):
    out = None
    g = _google(t)
    for k in _KINDS:
        tagged = P.tag_periods(g, "date_day", _P30, P.comparison_range(*_P30, k))
        s = tagged.groupBy("period").agg(F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"))
        s = s.select(F.lit(k).alias("kind"), "period", "spend", "clicks")
        out = s if out is None else out.unionByName(s)
    return out


@register("p05_inclusive_string_dates", f"""
SELECT COUNT(*) AS days, CAST(SUM(CAST(sessions AS BIGINT)) AS BIGINT) AS sessions FROM web_sessions_raw
WHERE CAST(strptime(date, '%Y%m%d') AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", ["web_sessions_raw"])
def p05(t):
    r = ad.web_sessions_raw(t).withColumn("d", FN.to_day("date"))
    return r.where(P.in_range("d", "2024-01-05", "2024-01-20")).agg(
        F.count(F.lit(1)).alias("days"), F.sum(FN.safe_int("sessions")).alias("sessions"))


@register("p06_p07_open_and_half_open", f"""
SELECT {R(f"SUM(CASE WHEN date_day >= DATE '2001-10-01' THEN spend END)")} AS since_cutoff,
  {R(f"SUM(CASE WHEN date_day >= DATE '2001-09-01' AND date_day < DATE '2001-10-01' THEN spend END)")} AS previous_half_open
FROM ads_lean WHERE platform = 'google_ads'""", ["ads_lean"])
def p06(t):
    g = _google(t)
    return g.agg(F.sum(F.when(P.since("date_day", "2001-10-01"), F.col("spend"))).alias("since_cutoff"),
                 F.sum(F.when(P.half_open("date_day", "2001-09-01", "2001-10-01"), F.col("spend"))).alias("previous_half_open"))


@register("p08_p09_filters", f"""
SELECT account_id, sessionMedium, CAST(SUM(sessions) AS BIGINT) AS sessions FROM (
  SELECT 'acct_' || CAST(user_id % 4 AS VARCHAR) AS account_id, sessionMedium, sessions FROM (
    SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'referral' WHEN 3 THEN '(none)'
      ELSE 'email' END AS sessionMedium,
      CASE WHEN user_id % 12 = 0 THEN '(not set)' ELSE 'c' || CAST(user_id % 12 AS VARCHAR) END AS campaign, 1 AS sessions
    FROM events) WHERE campaign IS NOT NULL AND campaign <> '(not set)')
WHERE account_id = 'acct_1' GROUP BY 1, 2""")
def p08(t):
    e = t.events.select("user_id")
    k = F.col("user_id") % 12
    x = e.select(
        F.concat(F.lit("acct_"), (F.col("user_id") % 4).cast("string")).alias("account_id"),
        ad._pick(F.col("user_id") % 5, ad.MEDIUMS).alias("sessionMedium"),
        F.when(k == 0, "(not set)").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("campaign"),
    )
    x = x.where(FN.is_set("campaign")).where(FN.optional_equals("account_id", "acct_1")).where(FN.optional_equals("sessionMedium", None))
    return x.groupBy("account_id", "sessionMedium").agg(F.count(F.lit(1)).alias("sessions"))


_TYPES = ("SEARCH", "PERFORMANCE_MAX", "DEMAND_GEN", "BRAND_NEW_TYPE", "", None, "LOCAL_SERVICES")


@register("p11_campaign_type_labels", """
SELECT CASE l_suppkey % 7 WHEN 0 THEN 'Search' WHEN 1 THEN 'PMax' WHEN 2 THEN 'Demand Gen' WHEN 3 THEN 'Brand New Type' WHEN 6 THEN 'Local Svc'
  ELSE 'Unknown' END AS campaign_type, COUNT(*) AS lines FROM lineitem GROUP BY 1""")
def p11(t):
    raw = F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("l_suppkey") % 7).cast("int"))
    return t.lineitem.select(FN.campaign_type_label(raw).alias("campaign_type")).groupBy("campaign_type").agg(F.count("*").alias("lines"))


@register("p10_distinct_accounts", "SELECT DISTINCT account_id FROM ads_lean WHERE platform = 'meta_ads'", ["ads_lean"])
def p10(t):
    return T.distinct_keys(ad.ads(t, dims=False).where(F.col("platform") == "meta_ads"), ["account_id"])


@register("p12_date_validity", """
SELECT event_type, COUNT(*) FILTER (WHERE event_id % 3 = 2) AS invalid_dates,
  CAST(date_diff('day', MIN(CASE WHEN event_id % 3 <> 2 THEN CAST(ts AS DATE) END),
    MAX(CASE WHEN event_id % 3 <> 2 THEN CAST(ts AS DATE) END)) + 1 AS INTEGER) AS days_between
FROM events GROUP BY event_type""")
def p12(t):
    e = t.events
    k = F.col("event_id") % 3
    s = (F.when(k == 0, F.date_format("ts", "yyyyMMdd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd"))
         .otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))))
    return P.date_validity(e.withColumn("d", s), "d", ["event_type"]).withColumn("invalid_dates", F.col("invalid_dates").cast("bigint"))


# ---------------------------------------------------------------- T02-T08
@register("t02_top_posts", """
SELECT tweet_id, tweet_type, likes + retweets + replies + quotes + bookmarks AS engagement FROM posts
WHERE tweet_type = 'quote' ORDER BY engagement DESC, tweet_id LIMIT 10""", ["posts"])
def t02(t):
    p = ad.posts(t).where(F.col("tweet_type") == "quote")
    eng = F.col("likes") + F.col("retweets") + F.col("replies") + F.col("quotes") + F.col("bookmarks")
    return T.top_k(p.select("tweet_id", "tweet_type", eng.alias("engagement")), [F.desc("engagement"), "tweet_id"], 10)


@register("t03_best_worst_campaigns", f"""
WITH g AS (SELECT campaign_name, SUM(conversions) / NULLIF(SUM(spend), 0) AS efficiency FROM ads WHERE platform = 'google_ads'
  GROUP BY campaign_name),
b AS (SELECT *, 'largest' AS side FROM g ORDER BY efficiency DESC NULLS LAST, campaign_name LIMIT 5),
s AS (SELECT *, 'smallest' AS side FROM (SELECT * FROM g WHERE efficiency IS NOT NULL ORDER BY efficiency, campaign_name LIMIT 5)
  WHERE efficiency > 0)
SELECT campaign_name, {R('efficiency')} AS efficiency, side FROM (SELECT * FROM b UNION ALL SELECT * FROM s)""", ["ads"])
def t03(t):
    g = ad.ads(t).where(F.col("platform") == "google_ads").groupBy("campaign_name").agg(
        FN.div(F.sum("conversions"), F.sum("spend")).alias("efficiency"))
    return T.largest_smallest(g, "efficiency", "campaign_name", 5)


@register("t04_country_others", """
WITH g AS (SELECT country, SUM(sessions) AS sessions FROM web_geo GROUP BY country),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sessions DESC, country) AS rk FROM g)
SELECT country, CAST(sessions AS BIGINT) AS sessions FROM r WHERE rk <= 8
UNION ALL
SELECT 'Others', CAST(SUM(sessions) AS BIGINT) FROM r WHERE rk > 8 HAVING SUM(sessions) > 0""", ["web_geo"])
def t04(t):
    g = ad.web_geo(t).groupBy("country").agg(F.sum("sessions").alias("sessions"))
    return T.top_n_others(g, "country", "sessions", 8)


@register("t06_latest_row", f"""
SELECT {DS('date_day')} AS date_day, CAST(sessions AS BIGINT) AS sessions, CAST(users AS BIGINT) AS users,
  CAST(new_users AS BIGINT) AS new_users, {R('bounce_rate')} AS bounce_rate
FROM web_daily ORDER BY date_day DESC LIMIT 1""", ["web_daily"])
def t06(t):
    return T.latest_row(ad.web_daily(t), "date_day")


@register("t07_platform_union", f"""
WITH u AS (
  SELECT 'Google Ads' AS platform, campaign_name, SUM(spend) AS spend, SUM(conversions) AS conversions
  FROM ads WHERE platform = 'google_ads' GROUP BY campaign_name HAVING SUM(spend) > 0
  UNION ALL
  SELECT 'Meta Ads', campaign_name, SUM(spend), CAST(SUM(COALESCE(app_installs, 0) + COALESCE(purchases, 0)) AS DOUBLE)
  FROM ads WHERE platform = 'meta_ads' GROUP BY campaign_name HAVING SUM(spend) > 0)
SELECT platform, campaign_name, {R('spend')} AS spend, {R('conversions')} AS conversions FROM u""", ["ads"])
def t07(t):
    return N.quadrant_inputs(ad.ads(t)).select("platform", "campaign_name", "spend", "conversions")


# ---------------------------------------------------------------- S17
def _per_ad(t):
    m = t.lineitem.where(F.col("l_linestatus") == "O")
    return m.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").cast("string").alias("ad_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint") * 20).alias("impressions"), F.sum(F.col("l_extendedprice") / 1000).alias("spend"))


def _ads_meta(t):
    return t.part.select(F.col("p_partkey").cast("string").alias("ad_id"), F.col("p_name").alias("ad_name"),
                         F.col("p_size").cast("string").alias("adset_id"), F.col("p_brand").alias("campaign_id"))


@register("s17_ad_insights_fallback", f"""
WITH pa AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS ad_id,
  SUM(CAST(l_quantity AS BIGINT) * 20) AS impressions, SUM(l_extendedprice / 1000) AS spend
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT {DS('date')} AS date, pa.ad_id, CAST(impressions AS BIGINT) AS impressions, {R('spend')} AS spend,
  CAST(p_size AS VARCHAR) AS adset_id, p_brand AS campaign_id, '' AS campaign_name, '' AS adset_name, p_name AS ad_name
FROM pa JOIN part ON pa.ad_id = CAST(p_partkey AS VARCHAR)""")
def s17(t):
    per_ad = _per_ad(t)
    primary = per_ad.where(F.col("date") > F.lit("2100-01-01").cast("date")).withColumn("campaign_name", F.lit("x")).withColumn(
        "adset_name", F.lit("x")).withColumn("ad_name", F.lit("x")).withColumn("adset_id", F.lit("x")).withColumn("campaign_id", F.lit("x"))
    return S.ad_insights_with_fallback(primary, per_ad, _ads_meta(t))


@register("s17_ad_insights_primary", f"""
SELECT {DS('CAST(l_shipdate AS DATE)')} AS date, CAST(l_partkey AS VARCHAR) AS ad_id,
  CAST(SUM(CAST(l_quantity AS BIGINT) * 20) AS BIGINT) AS impressions, {R('SUM(l_extendedprice / 1000)')} AS spend,
  CAST(l_partkey % 9 AS VARCHAR) AS adset_id, CAST(l_partkey % 5 AS VARCHAR) AS campaign_id, 'c' || CAST(l_partkey % 5 AS VARCHAR) AS campaign_name,
  's' || CAST(l_partkey % 9 AS VARCHAR) AS adset_name, 'a' || CAST(l_partkey AS VARCHAR) AS ad_name
FROM lineitem WHERE l_linestatus = 'O' GROUP BY CAST(l_shipdate AS DATE), l_partkey""")
def s17_primary(t):
    per_ad = _per_ad(t)
    n = F.col("ad_id").cast("bigint")
    primary = per_ad.withColumns({
        "campaign_name": F.concat(F.lit("c"), (n % 5).cast("string")), "adset_name": F.concat(F.lit("s"), (n % 9).cast("string")),
        "ad_name": F.concat(F.lit("a"), F.col("ad_id")), "adset_id": (n % 9).cast("string"), "campaign_id": (n % 5).cast("string")})
    return S.ad_insights_with_fallback(primary, per_ad, _ads_meta(t))


# ---------------------------------------------------------------- A47 status
def _meta_objects(t):
    p = t.part.select("p_partkey", "p_brand", "p_size")
    num = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    acct = F.concat(F.lit("acct_"), (num % 4).cast("string"))
    camps = p.select("p_brand", num.alias("n")).distinct().select(
        F.concat(F.lit("acct_"), (F.col("n") % 4).cast("string")).alias("account_id"), F.lit("campaign").alias("level"),
        F.when(F.col("n") % 2 == 0, "ACTIVE").otherwise("PAUSED").alias("status"))
    sets = p.select(acct.alias("account_id"), "p_brand", "p_size").distinct().select(
        "account_id", F.lit("adset").alias("level"), F.when(F.col("p_size") % 3 == 0, "PAUSED").otherwise("ACTIVE").alias("status"))
    ads = p.select(acct.alias("account_id"), F.lit("ad").alias("level"),
                   F.when(F.col("p_partkey") % 4 == 0, "PAUSED").when(F.col("p_partkey") % 4 == 1, "ARCHIVED").otherwise("ACTIVE").alias("status"))
    return camps.unionByName(sets).unionByName(ads)


@register("a47_status_counts", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS n FROM part),
o AS (
  SELECT DISTINCT 'acct_' || CAST(n % 4 AS VARCHAR) AS account_id, 'campaign' AS level, p_brand AS k1, 0 AS k2,
    CASE WHEN n % 2 = 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS status FROM p
  UNION ALL
  SELECT DISTINCT 'acct_' || CAST(n % 4 AS VARCHAR), 'adset', p_brand, p_size, CASE WHEN p_size % 3 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END FROM p
  UNION ALL
  SELECT 'acct_' || CAST(n % 4 AS VARCHAR), 'ad', p_brand, p_partkey,
    CASE WHEN p_partkey % 4 = 0 THEN 'PAUSED' WHEN p_partkey % 4 = 1 THEN 'ARCHIVED' ELSE 'ACTIVE' END FROM p)
SELECT account_id, level, COUNT(CASE WHEN status = 'ACTIVE' THEN 1 END) AS active,
  COUNT(CASE WHEN status = 'PAUSED' THEN 1 END) AS paused, COUNT(*) AS total FROM o GROUP BY 1, 2""")
def a47s(t):
    return A.status_counts(_meta_objects(t))


# ---------------------------------------------------------------- P01 / P02 / F06
@register("p01_p02_load_windows", """
WITH a AS (SELECT max(CAST(ts AS DATE)) AS d, CAST(ts AS DATE) AS day FROM events GROUP BY 2),
b AS (SELECT max(day) AS t FROM a),
w(name, s, e) AS (SELECT * FROM (SELECT 'default', t - 30, t - 1 FROM b UNION ALL SELECT 'last_7', t - 7, t - 1 FROM b
  UNION ALL SELECT 'from_start', DATE '2024-01-10', t - 1 FROM b UNION ALL SELECT 'closed', DATE '2024-01-10', DATE '2024-01-12' FROM b
  UNION ALL SELECT 'lifetime', DATE '2020-01-01', t - 1 FROM b UNION ALL SELECT 'social', t - 30, t FROM b
  UNION ALL SELECT 'social_lifetime', t - 400, t FROM b))
SELECT name, CAST(CAST(s AS DATE) AS VARCHAR) AS first_day, CAST(CAST(e AS DATE) AS VARCHAR) AS last_day,
  (SELECT COUNT(*) FROM events WHERE CAST(ts AS DATE) BETWEEN CAST(s AS DATE) AND CAST(e AS DATE)) AS events FROM w""")
def p01_p02(t):
    """The load windows as of the last day of the stream, and the events that each would load (one pass)."""
    day = F.to_date("ts")
    as_of = t.events.select(F.max(day)).first()[0]
    windows = {
        "default": P.etl_range(as_of), "last_7": P.etl_range(as_of, 7), "from_start": P.etl_range(as_of, start="2024-01-10"),
        "closed": P.etl_range(as_of, start="2024-01-10", end="2024-01-12"), "lifetime": P.etl_range(as_of, lifetime_start="2020-01-01"),
        "social": P.social_range(as_of), "social_lifetime": P.social_range(as_of, lifetime=True)}
    counts = t.events.agg(*[F.count(F.when(P.in_range(day, *w), 1)).alias(n) for n, w in windows.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w[0]).alias("first_day"), F.lit(w[1]).alias("last_day"), F.col(n).alias("events"))
                     for n, w in windows.items()])
    return counts.select(F.inline(rows))


@register("f06_clean_columns", """
SELECT l_returnflag AS "ga_flag__", COUNT(*) AS "cost__USD_", CAST(MAX(l_linenumber) AS BIGINT) AS "max_line_" FROM lineitem GROUP BY 1""")
def f06(t):
    out = t.lineitem.groupBy(F.col("l_returnflag").alias("ga:flag %")).agg(
        F.count(F.lit(1)).alias("cost (USD)"), F.max("l_linenumber").cast("long").alias("max-line\u00e9"))
    return FN.clean_columns(out)
