"""Adapters: driver tables -> marketing-shaped facts.

The driver gives TPC-H-like tables plus an ``events`` stream. Each adapter
derives one reference-shaped fact from them, once as a DataFrame plan (used by
``queries()``) and once as a DuckDB SQL CTE (used by ``oracle_sql()``). The
two must agree row for row; the rule is written next to each pair.

All adapters are narrow projections or one grouped aggregate, so Catalyst
prunes the scan to the referenced columns and pushes filters of the caller
down into the parquet reader. Joins are left to the planner (AQE picks
broadcast only when the runtime size allows it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import functools

from mkpulse.functions import div
from mkpulse.session import Tables


def _memo(fn):
    """Reuse an adapter's (immutable, lazy) plan within one ``Tables``: facts
    that a query uses twice are analysed once."""

    @functools.wraps(fn)
    def wrapper(t: Tables, *args, **kwargs):
        key = (fn.__name__, args, tuple(sorted(kwargs.items())))
        if key not in t.memo:
            t.memo[key] = fn(t, *args, **kwargs)
        return t.memo[key]

    return wrapper


# fixed values used by the derived dimensions (labels of the fixture rules)
MATCH_TYPES = {"A": "EXACT", "N": "PHRASE", "R": "BROAD"}
DEVICES = ("MOBILE", "DESKTOP", "TABLET")  # by l_linenumber % 3
MEDIUMS = ("cpc", "organic", "referral", "(none)", "email")  # by user_id % 5
WEB_DEVICES = ("desktop", "mobile", "tablet")  # by user_id % 3
WEB_OS = ("Windows", "macOS", "Android", "iOS")  # by user_id % 4
WEB_BROWSERS = ("Chrome", "Safari")  # by user_id % 2
PUBLISHERS = ("facebook", "instagram", "audience_network")  # by o_orderkey % 3


def _pick(expr: Column, labels) -> Column:
    """labels[expr] as a CASE chain (no array literal, keeps codegen simple)."""
    out = None
    for i, lab in enumerate(labels):
        out = F.when(expr == i, F.lit(lab)) if out is None else out.when(expr == i, F.lit(lab))
    return out


def _sql_pick(expr: str, labels) -> str:
    arms = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(labels))
    return f"CASE {expr} {arms} END"


# --------------------------------------------------------------------------- paid
@_memo
def ads(t: Tables, dims: bool = True) -> DataFrame:
    """Paid fact at line grain (search ads + social ads).

    F lines are search ads (``google_ads``), O lines social ads (``meta_ads``).
    ``dims=False`` skips the part join when no campaign column is needed.
    """
    li = t.lineitem
    plat = F.when(F.col("l_linestatus") == "F", "google_ads").otherwise("meta_ads")
    conv = F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)
    is_meta = F.col("l_linestatus") != "F"
    clicks = F.col("l_quantity").cast("bigint")
    cols = [
        F.to_date("l_shipdate").alias("date_day"),
        plat.alias("platform"),
        F.concat(F.lit("acct_"), (F.col("l_suppkey") % 4).cast("string")).alias("account_id"),
        _pick(F.col("l_linenumber") % 3, DEVICES).alias("device"),
        (F.col("l_suppkey") % 30 + 2000).alias("country_criterion_id"),
        (F.col("l_extendedprice") / 1000).alias("spend"),
        F.round(F.col("l_extendedprice") * 1000).cast("bigint").alias("cost_micros"),
        clicks.alias("clicks"),
        (clicks * 20).alias("impressions"),
        (clicks * (F.col("l_linenumber") + 8)).alias("reach"),
        (F.lit(100.0) / (F.col("l_linenumber") + 8)).alias("ctr"),
        (F.lit(20.0) / (F.col("l_linenumber") + 8)).alias("frequency"),
        conv.alias("conversions"),
        F.when(is_meta, F.when(F.col("l_tax") >= 0.05, 1).otherwise(0)).cast("bigint").alias("app_installs"),
        F.when(is_meta, conv.cast("bigint")).alias("purchases"),
        (conv * F.col("l_extendedprice") / 100).alias("conversion_value"),
    ]
    if not dims:
        return li.select(*cols)
    match = F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "N", "PHRASE").otherwise("BROAD")
    p = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        *cols,
        F.col("p_brand").alias("campaign_name"),
        F.col("p_type").alias("campaign_type"),
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("ad_group_name"),
        F.col("p_name").alias("keyword_text"),
        match.alias("keyword_match_type"),
        F.col("p_partkey").alias("keyword_id"),
    )


_ADS_COLS = f"""
    CAST(l_shipdate AS DATE) AS date_day,
    CASE WHEN l_linestatus = 'F' THEN 'google_ads' ELSE 'meta_ads' END AS platform,
    'acct_' || CAST(l_suppkey % 4 AS VARCHAR) AS account_id,
    {_sql_pick('l_linenumber % 3', DEVICES)} AS device,
    l_suppkey % 30 + 2000 AS country_criterion_id,
    l_extendedprice / 1000 AS spend,
    CAST(ROUND(l_extendedprice * 1000) AS BIGINT) AS cost_micros,
    CAST(l_quantity AS BIGINT) AS clicks,
    CAST(l_quantity AS BIGINT) * 20 AS impressions,
    CAST(l_quantity AS BIGINT) * (l_linenumber + 8) AS reach,
    100.0::DOUBLE / (l_linenumber + 8) AS ctr,
    20.0::DOUBLE / (l_linenumber + 8) AS frequency,
    CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS conversions,
    CASE WHEN l_linestatus <> 'F' THEN CAST(CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END AS BIGINT) END AS app_installs,
    CASE WHEN l_linestatus <> 'F' THEN CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS BIGINT) END AS purchases,
    CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE * l_extendedprice / 100 AS conversion_value"""

SQL: dict[str, str] = {}

SQL["ads"] = f"""SELECT {_ADS_COLS},
    p_brand AS campaign_name, p_type AS campaign_type,
    p_brand || '/' || CAST(p_size AS VARCHAR) AS ad_group_name,
    p_name AS keyword_text,
    CASE l_returnflag WHEN 'A' THEN 'EXACT' WHEN 'N' THEN 'PHRASE' ELSE 'BROAD' END AS keyword_match_type,
    p_partkey AS keyword_id
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

SQL["ads_lean"] = f"SELECT {_ADS_COLS} FROM lineitem"


# ------------------------------------------------------------------------ organic
@_memo
def organic(t: Tables) -> DataFrame:
    """Organic search fact (query x page x device per order line)."""
    o = t.orders.select("o_orderkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    p = t.part.select("p_partkey", "p_name", "p_type", "p_size")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, F.col("l_partkey") == p.p_partkey)
    clicks = F.col("l_linenumber").cast("bigint")
    impr = F.col("l_quantity").cast("bigint") * 10
    return j.select(
        F.to_date("o_orderdate").alias("date_day"),
        F.lower("p_name").alias("query"),
        F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string")).alias("page"),
        _pick(F.col("l_linenumber") % 3, DEVICES).alias("device"),
        clicks.alias("clicks"),
        impr.alias("impressions"),
        (F.length("p_name") % 8 + 1 + (F.col("l_linenumber") % 3) * 0.5).alias("position"),
        div(clicks, impr).alias("ctr"),
    )


SQL["organic"] = f"""SELECT CAST(o_orderdate AS DATE) AS date_day,
    lower(p_name) AS query,
    '/' || lower(p_type) || '/' || CAST(p_size AS VARCHAR) AS page,
    {_sql_pick('l_linenumber % 3', DEVICES)} AS device,
    CAST(l_linenumber AS BIGINT) AS clicks,
    CAST(l_quantity AS BIGINT) * 10 AS impressions,
    CAST(length(p_name) % 8 + 1 + (l_linenumber % 3) * 0.5 AS DOUBLE) AS position,
    CAST(l_linenumber AS BIGINT) / NULLIF(CAST(l_quantity AS BIGINT) * 10, 0) AS ctr
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"""


@_memo
def organic_daily(t: Tables) -> DataFrame:
    """V07 fact_organic_daily: Σclicks, Σimpressions, AVG ctr, AVG position."""
    return organic(t).groupBy("date_day").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("ctr"),
        F.avg("position").alias("position"),
    )


SQL["organic_daily"] = """SELECT date_day, CAST(SUM(clicks) AS BIGINT) AS clicks,
    CAST(SUM(impressions) AS BIGINT) AS impressions, AVG(ctr) AS ctr, AVG(position) AS position
  FROM organic GROUP BY date_day"""


# ---------------------------------------------------------------------------- web
def _ev(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", "value")


@_memo
def web_sessions_raw(t: Tables) -> DataFrame:
    """ga4_sessions bronze shape: every column a string, date as yyyyMMdd."""
    e = _ev(t)
    return e.groupBy(F.date_format("ts", "yyyyMMdd").alias("date")).agg(
        F.count(F.lit(1)).cast("string").alias("sessions"),
        F.countDistinct("user_id").cast("string").alias("totalUsers"),
        F.countDistinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).cast("string").alias("newUsers"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).cast("string").alias("bounceRate"),
    )


SQL["web_sessions_raw"] = """SELECT strftime(ts, '%Y%m%d') AS date,
    CAST(COUNT(*) AS VARCHAR) AS sessions,
    CAST(COUNT(DISTINCT user_id) AS VARCHAR) AS totalUsers,
    CAST(COUNT(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS VARCHAR) AS newUsers,
    CAST(AVG(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE) AS VARCHAR) AS bounceRate
  FROM events GROUP BY 1"""


@_memo
def web_daily(t: Tables) -> DataFrame:
    """V08 fact_web_daily: silver cast of ga4_sessions."""
    from mkpulse.functions import safe_float, safe_int, to_day

    r = web_sessions_raw(t)
    return r.select(
        to_day("date").alias("date_day"),
        safe_int("sessions").alias("sessions"),
        safe_int("totalUsers").alias("users"),
        safe_int("newUsers").alias("new_users"),
        safe_float("bounceRate").alias("bounce_rate"),
    )


SQL["web_daily"] = """SELECT CAST(strptime(date, '%Y%m%d') AS DATE) AS date_day,
    CAST(sessions AS BIGINT) AS sessions, CAST(totalUsers AS BIGINT) AS users,
    CAST(newUsers AS BIGINT) AS new_users, CAST(bounceRate AS DOUBLE) AS bounce_rate
  FROM web_sessions_raw"""


@_memo
def web_traffic(t: Tables) -> DataFrame:
    """ga4_traffic_overview (typed): date x source x medium x campaign."""
    e = _ev(t)
    k = F.col("user_id") % 12
    g = e.groupBy(
        F.to_date("ts").alias("date_day"),
        F.concat(F.lit("s"), k.cast("string")).alias("sessionSource"),
        _pick(F.col("user_id") % 5, MEDIUMS).alias("sessionMedium"),
        F.when(k == 0, "(not set)").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("sessionCampaignName"),
    )
    return g.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("user_id").alias("totalUsers"),
        F.countDistinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).alias("newUsers"),
        F.avg(k / 12.0).alias("bounceRate"),
        F.sum(F.col("user_id") % 5 + 1).alias("screenPageViews"),
    )


SQL["web_traffic"] = f"""SELECT CAST(ts AS DATE) AS date_day,
    's' || CAST(user_id % 12 AS VARCHAR) AS sessionSource,
    {_sql_pick('user_id % 5', MEDIUMS)} AS sessionMedium,
    CASE WHEN user_id % 12 = 0 THEN '(not set)' ELSE 'c' || CAST(user_id % 12 AS VARCHAR) END AS sessionCampaignName,
    COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS totalUsers,
    COUNT(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS newUsers,
    AVG(CAST(user_id % 12 AS DOUBLE) / 12) AS bounceRate,
    CAST(SUM(user_id % 5 + 1) AS BIGINT) AS screenPageViews
  FROM events GROUP BY 1, 2, 3, 4"""


@_memo
def web_pages(t: Tables) -> DataFrame:
    """ga4_page_performance (typed): date x pagePath x pageTitle."""
    e = _ev(t)
    k = (F.col("event_id") % 40).cast("string")
    return e.groupBy(
        F.to_date("ts").alias("date_day"),
        F.concat(F.lit("/p/"), k).alias("pagePath"),
        F.concat(F.lit("Page "), k).alias("pageTitle"),
    ).agg(
        F.sum(F.col("user_id") % 3 + 1).alias("screenPageViews"),
        F.count(F.lit(1)).alias("sessions"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("bounceRate"),
        F.avg("value").alias("averageSessionDuration"),
    )


SQL["web_pages"] = """SELECT CAST(ts AS DATE) AS date_day,
    '/p/' || CAST(event_id % 40 AS VARCHAR) AS pagePath,
    'Page ' || CAST(event_id % 40 AS VARCHAR) AS pageTitle,
    CAST(SUM(user_id % 3 + 1) AS BIGINT) AS screenPageViews,
    COUNT(*) AS sessions,
    AVG(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE) AS bounceRate,
    AVG(value) AS averageSessionDuration
  FROM events GROUP BY 1, 2, 3"""


@_memo
def web_tech(t: Tables) -> DataFrame:
    """ga4_technology_data (typed): date x device x os x browser."""
    e = _ev(t)
    return e.groupBy(
        F.to_date("ts").alias("date_day"),
        _pick(F.col("user_id") % 3, WEB_DEVICES).alias("deviceCategory"),
        _pick(F.col("user_id") % 4, WEB_OS).alias("operatingSystem"),
        _pick(F.col("user_id") % 2, WEB_BROWSERS).alias("browser"),
    ).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("user_id").alias("totalUsers"),
        F.sum(F.col("user_id") % 5 + 1).alias("screenPageViews"),
    )


SQL["web_tech"] = f"""SELECT CAST(ts AS DATE) AS date_day,
    {_sql_pick('user_id % 3', WEB_DEVICES)} AS deviceCategory,
    {_sql_pick('user_id % 4', WEB_OS)} AS operatingSystem,
    {_sql_pick('user_id % 2', WEB_BROWSERS)} AS browser,
    COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS totalUsers,
    CAST(SUM(user_id % 5 + 1) AS BIGINT) AS screenPageViews
  FROM events GROUP BY 1, 2, 3, 4"""


@_memo
def web_events(t: Tables) -> DataFrame:
    """ga4_event_data (typed): date x eventName."""
    return _ev(t).groupBy(F.to_date("ts").alias("date_day"), F.col("event_type").alias("eventName")).agg(
        F.count(F.lit(1)).alias("eventCount"), F.countDistinct("user_id").alias("totalUsers")
    )


SQL["web_events"] = """SELECT CAST(ts AS DATE) AS date_day, event_type AS eventName,
    COUNT(*) AS eventCount, COUNT(DISTINCT user_id) AS totalUsers
  FROM events GROUP BY 1, 2"""


@_memo
def web_geo(t: Tables) -> DataFrame:
    """ga4_geographic_data (typed): orders by customer nation / region / segment."""
    o = t.orders.select("o_orderdate", "o_custkey", "o_orderstatus")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    )
    return j.groupBy(
        F.to_date("o_orderdate").alias("date_day"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("city"),
    ).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("o_custkey").alias("totalUsers"),
        F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("newUsers"),
    )


SQL["web_geo"] = """SELECT CAST(o_orderdate AS DATE) AS date_day, n_name AS country,
    r_name AS region, c_mktsegment AS city,
    COUNT(*) AS sessions, COUNT(DISTINCT o_custkey) AS totalUsers,
    COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS newUsers
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4"""


# ------------------------------------------------------------------------- hourly
@_memo
def hourly(t: Tables) -> DataFrame:
    """gads_hourly-like: date x campaign x hour from events."""
    e = _ev(t)
    return e.groupBy(
        F.to_date("ts").alias("date_day"),
        F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("campaign_name"),
        F.hour("ts").alias("hour"),
    ).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).cast("double").alias("conversions"),
        F.sum("value").alias("cost"),
    )


SQL["hourly"] = """SELECT CAST(ts AS DATE) AS date_day,
    'c' || CAST(user_id % 6 AS VARCHAR) AS campaign_name,
    CAST(hour(ts) AS INTEGER) AS hour,
    COUNT(*) AS impressions,
    COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
    CAST(COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) AS conversions,
    SUM(value) AS cost
  FROM events GROUP BY 1, 2, 3"""


# -------------------------------------------------------------------------- posts
@_memo
def posts(t: Tables) -> DataFrame:
    """twitter_tweets-like posts from conversation turns."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    ln = F.length("text").cast("bigint")
    typ = F.when(F.col("role") == "assistant", "reply").when(F.col("turn") == 0, "original").otherwise("quote")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("tweet_id"),
        typ.alias("tweet_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("created_date"),
        ln.alias("impressions"),
        (ln % 17).alias("likes"),
        (F.col("turn") % 5).alias("retweets"),
        (F.col("conv_id") % 4).alias("replies"),
        (ln % 3).alias("quotes"),
        (F.col("turn") % 2).alias("bookmarks"),
    )


SQL["posts"] = """SELECT conv_id * 100 + turn AS tweet_id,
    CASE WHEN role = 'assistant' THEN 'reply' WHEN turn = 0 THEN 'original' ELSE 'quote' END AS tweet_type,
    DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS created_date,
    CAST(length(text) AS BIGINT) AS impressions,
    CAST(length(text) AS BIGINT) % 17 AS likes,
    turn % 5 AS retweets, conv_id % 4 AS replies,
    CAST(length(text) AS BIGINT) % 3 AS quotes, turn % 2 AS bookmarks
  FROM conversations"""


# ---------------------------------------------------------------------- social demo
@_memo
def social_breakdowns(t: Tables) -> DataFrame:
    """meta_demographics / devices / geographic rows from orders x customer x nation."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    bal = F.col("c_acctbal")
    age = (
        F.when(bal < 0, "13-17").when(bal < 2000, "18-24").when(bal < 4000, "25-34")
        .when(bal < 6000, "35-44").when(bal < 8000, "45-54").otherwise("55-64")
    )
    return j.select(
        F.to_date("o_orderdate").alias("date_start"),
        age.alias("age"),
        _pick(F.col("o_custkey") % 3, ("male", "female", "unknown")).alias("gender"),
        F.when(F.col("o_custkey") % 2 == 0, "mobile_app").otherwise("desktop").alias("device_platform"),
        _pick(F.col("o_orderkey") % 3, PUBLISHERS).alias("publisher_platform"),
        F.col("n_name").alias("country"),
        F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("impressions"),
        (F.col("o_orderkey") % 50).alias("clicks"),
        (F.col("o_totalprice") / 1000).alias("spend"),
        (F.col("o_orderkey") % 3).alias("app_installs"),
        (F.col("o_orderkey") % 2).alias("purchases"),
    )


SQL["social_breakdowns"] = f"""SELECT CAST(o_orderdate AS DATE) AS date_start,
    CASE WHEN c_acctbal < 0 THEN '13-17' WHEN c_acctbal < 2000 THEN '18-24'
         WHEN c_acctbal < 4000 THEN '25-34' WHEN c_acctbal < 6000 THEN '35-44'
         WHEN c_acctbal < 8000 THEN '45-54' ELSE '55-64' END AS age,
    {_sql_pick('o_custkey % 3', ('male', 'female', 'unknown'))} AS gender,
    CASE WHEN o_custkey % 2 = 0 THEN 'mobile_app' ELSE 'desktop' END AS device_platform,
    {_sql_pick('o_orderkey % 3', PUBLISHERS)} AS publisher_platform,
    n_name AS country,
    CAST(floor(o_totalprice / 10) AS BIGINT) AS impressions,
    o_orderkey % 50 AS clicks, o_totalprice / 1000 AS spend,
    o_orderkey % 3 AS app_installs, o_orderkey % 2 AS purchases
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


# ---------------------------------------------------------------------- duplicates
@_memo
def dup_lines(t: Tables) -> DataFrame:
    """A table with known duplicates on (l_orderkey, l_linenumber): every first
    line is landed twice, the second copy one day later; every third order's
    second copy has no extraction time."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    base = li.withColumn("extracted_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    again = li.where(F.col("l_linenumber") == 1).withColumn(
        "extracted_at",
        F.when(F.col("l_orderkey") % 3 != 0, F.lit("2024-01-02 00:00:00").cast("timestamp")),
    ).withColumn("l_quantity", F.col("l_quantity") + 1)
    return base.unionByName(again)


SQL["dup_lines"] = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    TIMESTAMP '2024-01-01 00:00:00' AS extracted_at FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, l_extendedprice,
    CASE WHEN l_orderkey % 3 <> 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS extracted_at
  FROM lineitem WHERE l_linenumber = 1"""


@_memo
def country_names(t: Tables) -> DataFrame:
    """P11 lookup: country criterion id -> name (2000 + nation key)."""
    return t.nation.select((F.col("n_nationkey") + 2000).cast("bigint").alias("criterion_id"), F.col("n_name").alias("country_name"))


SQL["country_names"] = "SELECT CAST(n_nationkey + 2000 AS BIGINT) AS criterion_id, n_name AS country_name FROM nation"

# dependency order of the SQL adapters (a CTE may only use earlier ones)
ORDER = [
    "ads", "ads_lean", "organic", "organic_daily", "web_sessions_raw", "web_daily", "web_traffic",
    "web_pages", "web_tech", "web_events", "web_geo", "hourly", "posts", "social_breakdowns",
    "dup_lines", "country_names",
]
_DEPS = {"organic_daily": ["organic"], "web_daily": ["web_sessions_raw"]}


def with_adapters(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (and their dependencies)."""
    need: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    need.sort(key=ORDER.index)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in need)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
