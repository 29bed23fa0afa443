"""Aggregations A01-A50.

Every operator is ``f(df, *, by=(), ...) -> DataFrame``: a hash aggregate
(partial aggregation before the shuffle, final after it) keyed by the
operator's own dimensions plus the caller's ``by`` entities. ``by=()`` is the
single-business case. Ratios are computed after the aggregate from the summed
parts, so they never force a second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.functions import col, div, nz, safe_divide
from mkpulse.operators.topk import order_key, spread_rank
from mkpulse.session import materialize

By = Sequence[str]


def _conv(df_conv: str = "conversions", installs: str = "app_installs") -> Column:
    """Search conversions plus app installs (NULL parts count as 0)."""
    return nz(df_conv) + nz(installs)


def _zero_if_empty(df: DataFrame, by: By, cols: Sequence[str]) -> DataFrame:
    """Global totals: NULL sums (no rows) become 0, as in the reference."""
    if by:
        return df
    return df.select(*[nz(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- executive page
def paid_totals(df: DataFrame, by: By = ()) -> DataFrame:
    """Σspend, Σclicks, Σimpressions, Σ(conversions+installs), Σrevenue."""
    out = df.groupBy(*by).agg(
        F.sum("spend").alias("spend"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(_conv()).alias("conversions"),
        F.sum(nz("conversion_value")).alias("revenue"),
    )
    return _zero_if_empty(out, by, ["spend", "clicks", "impressions", "conversions", "revenue"])


def web_totals(df: DataFrame, by: By = ()) -> DataFrame:
    """Σsessions, Σusers, Σnew_users, AVG(bounce_rate) on fact_web_daily."""
    return df.groupBy(*by).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("users").alias("users"),
        F.sum("new_users").alias("new_users"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )


def organic_totals(df: DataFrame, by: By = ()) -> DataFrame:
    """Σclicks, Σimpressions, AVG(ctr), AVG(position)."""
    return df.groupBy(*by).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("ctr"),
        F.avg("position").alias("position"),
    )


def channel_breakdown(df: DataFrame, by: By = ()) -> DataFrame:
    """Per platform; CPA NULL when there are no conversions."""
    g = df.groupBy(*by, F.col("platform").alias("channel")).agg(
        F.sum("spend").alias("spend"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(_conv()).alias("conversions"),
    )
    return g.withColumn("cpa", F.when(F.col("conversions") > 0, F.col("spend") / F.col("conversions")))


def channel_table(paid: DataFrame, organic: DataFrame, by: By = ()) -> DataFrame:
    """A04 plus an 'Organic Search' row when organic clicks > 0."""
    ch = channel_breakdown(paid, by)
    org = organic_totals(organic, by).where(F.col("clicks") > 0).select(
        *by,
        F.lit("Organic Search").alias("channel"),
        F.lit(0.0).alias("spend"),
        F.col("clicks").cast("bigint").alias("clicks"),
        F.col("impressions").cast("bigint").alias("impressions"),
        F.lit(0.0).alias("conversions"),
        F.lit(None).cast("double").alias("cpa"),
    )
    return ch.unionByName(org)


def daily_metric(df: DataFrame, value: Column | str, date_col: str = "date_day", by: By = ()) -> DataFrame:
    """One summed value per day."""
    return df.groupBy(*by, date_col).agg(F.sum(col(value)).alias("value"))


def kpi_tiles(paid: DataFrame, cur: tuple, prev: tuple, by: By = ()) -> DataFrame:
    """Current and previous paid totals in one pass, CPA, ROAS, deltas."""
    from mkpulse.functions import pct_change
    from mkpulse.functions.periods import tag_periods

    t = tag_periods(paid, "date_day", cur, prev)
    is_cur = F.col("period") == "current"
    is_prev = F.col("period") == "previous"

    def both(name: str, e: Column) -> list[Column]:
        return [
            F.sum(F.when(is_cur, e)).alias(f"{name}_cur"),
            F.sum(F.when(is_prev, e)).alias(f"{name}_prev"),
        ]

    g = t.groupBy(*by).agg(
        *both("spend", F.col("spend")),
        *both("conversions", _conv()),
        *both("clicks", F.col("clicks")),
        *both("revenue", nz("conversion_value")),
    )
    for c in [x for x in g.columns if x not in by]:
        g = g.withColumn(c, nz(c))
    g = (
        g.withColumn("cpa_cur", F.when(F.col("conversions_cur") > 0, F.col("spend_cur") / F.col("conversions_cur")))
        .withColumn("cpa_prev", F.when(F.col("conversions_prev") > 0, F.col("spend_prev") / F.col("conversions_prev")))
        .withColumn("roas", F.when(F.col("spend_cur") > 0, F.col("revenue_cur") / F.col("spend_cur")))
        .withColumn("spend_delta", pct_change("spend_cur", "spend_prev"))
        .withColumn("conversions_delta", pct_change("conversions_cur", "conversions_prev"))
        .withColumn("clicks_delta", pct_change("clicks_cur", "clicks_prev"))
        .withColumn(
            "cpa_delta",
            F.when(F.col("cpa_cur").isNotNull() & F.col("cpa_prev").isNotNull(), pct_change("cpa_cur", "cpa_prev")),
        )
    )
    return g


# fixed values: default targets of the target tracker
DEFAULT_TARGETS = {"conversions": 1000, "cpa": 5.00, "budget": 10000}


def target_tracking(totals: DataFrame, conversions_target=1000, cpa_target=5.0, budget=10000.0) -> DataFrame:
    """RAG status per target from A01 totals (any ``by`` columns kept)."""
    conv = nz("conversions")
    conv_prog = F.least(
        F.when(F.lit(conversions_target) > 0, conv / F.lit(float(conversions_target))).otherwise(0.0), F.lit(1.5)
    )
    cpa = F.when(conv > 0, F.col("spend") / conv).otherwise(0.0)
    spend_prog = F.when(F.lit(budget) > 0, nz("spend") / F.lit(float(budget))).otherwise(0.0)
    rag = lambda ok, warn: F.when(ok, "green").when(warn, "amber").otherwise("red")
    return totals.select(
        *[c for c in totals.columns],
        conv_prog.alias("conversion_progress"),
        rag(conv_prog >= 1.0, conv_prog >= 0.7).alias("conversion_status"),
        cpa.alias("current_cpa"),
        F.when(cpa <= cpa_target, 1.0).when(cpa <= cpa_target * 1.2, 0.7).otherwise(0.3).alias("cpa_progress"),
        rag(cpa <= cpa_target, cpa <= cpa_target * 1.2).alias("cpa_status"),
        spend_prog.alias("budget_progress"),
        rag(spend_prog <= 0.9, spend_prog <= 1.0).alias("budget_status"),
    )


# ------------------------------------------------------------------ web analytics
def web_summary(sessions_raw: DataFrame, cur: tuple, prev: tuple | None = None, by: By = ()) -> DataFrame:
    """Web executive summary over the bronze (string) sessions table.

    Casts inline like the reference, counts distinct days, engagement = 1 -
    bounce, engaged sessions = int(sessions x engagement); previous period
    sessions/new users and their %-changes in the same pass.
    """
    from mkpulse.functions import pct_change_abs, safe_float, safe_int, to_day
    from mkpulse.functions.periods import tag_periods

    df = sessions_raw.withColumn("_d", to_day("date"))
    t = tag_periods(df, "_d", cur, prev)
    cur_ = F.col("period") == "current"
    prev_ = F.col("period") == "previous"
    g = t.groupBy(*by).agg(
        F.sum(F.when(cur_, safe_int("sessions", None))).alias("sessions"),
        F.sum(F.when(cur_, safe_int("newUsers", None))).alias("new_users"),
        F.sum(F.when(cur_, safe_int("totalUsers", None))).alias("total_users"),
        F.avg(F.when(cur_, safe_float("bounceRate", None))).alias("avg_bounce_rate"),
        F.countDistinct(F.when(cur_, F.col("date"))).alias("days_count"),
        F.sum(F.when(prev_, safe_int("sessions", None))).alias("prev_sessions"),
        F.sum(F.when(prev_, safe_int("newUsers", None))).alias("prev_new_users"),
    )
    eng = 1.0 - nz("avg_bounce_rate", 0.0)
    return (
        g.withColumn("sessions", nz("sessions"))
        .withColumn("new_users", nz("new_users"))
        .withColumn("total_users", nz("total_users"))
        .withColumn("engagement_rate", eng)
        .withColumn("engaged_sessions", F.floor(F.col("sessions") * eng).cast("bigint"))
        .withColumn("sessions_delta", pct_change_abs("sessions", "prev_sessions"))
        .withColumn("new_users_delta", pct_change_abs("new_users", "prev_new_users"))
    )


def traffic_by_source(traffic: DataFrame, by: By = ()) -> DataFrame:
    """A10 (before top-k): source/medium sums, AVG bounce, page views."""
    return (
        traffic.where(F.col("sessionSource").isNotNull() & F.col("sessionMedium").isNotNull())
        .groupBy(*by, F.col("sessionSource").alias("source"), F.col("sessionMedium").alias("medium"))
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("totalUsers").alias("users"),
            F.sum("newUsers").alias("new_users"),
            F.avg("bounceRate").alias("bounce_rate"),
            F.sum("screenPageViews").alias("page_views"),
        )
    )


def campaign_intent(traffic: DataFrame, by: By = ()) -> DataFrame:
    """A11 (before top-k): campaign x medium with intent label by bounce rate."""
    g = (
        traffic.where(F.col("sessionCampaignName").isNotNull() & (F.col("sessionCampaignName") != "(not set)"))
        .groupBy(*by, F.col("sessionCampaignName").alias("campaign"), F.col("sessionMedium").alias("medium"))
        .agg(
            F.sum("sessions").alias("sessions"),
            F.avg("bounceRate").alias("bounce_rate"),
            F.sum("screenPageViews").alias("page_views"),
        )
    )
    b = F.col("bounce_rate")
    return (
        g.withColumn("engagement_rate", 1.0 - b)
        .withColumn("pages_per_session", div("page_views", "sessions"))
        .withColumn("intent_match", F.when(b > 0.7, "Poor Match").when(b < 0.4, "Good Match").otherwise("Fair"))
    )


def landing_pages(pages: DataFrame, by: By = ()) -> DataFrame:
    """A12 (before top-k by sessions): page path/title sums, AVG bounce, AVG
    duration, engagement rate."""
    return (
        pages.where(F.col("pagePath").isNotNull())
        .groupBy(*by, F.col("pagePath").alias("page_path"), F.col("pageTitle").alias("page_title"))
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("screenPageViews").alias("page_views"),
            F.avg("bounceRate").alias("bounce_rate"),
            F.avg("averageSessionDuration").alias("avg_duration"),
        )
        .withColumn("engagement_rate", 1.0 - F.col("bounce_rate"))
    )


def funnel_counts(sessions: DataFrame, pages: DataFrame, by: By = ()) -> DataFrame:
    """Funnel entry counts. Sessions from the sessions table, page views
    = distinct (date, path) pairs (NULL path not counted), engaged = int(sessions
    x (1 - avg bounce)) with engagement 0.5 when bounce is NULL/0, conversions 0."""
    s = sessions.groupBy(*by).agg(F.sum("sessions").alias("sessions"), F.avg("bounce_rate").alias("avg_bounce"))
    p = pages.groupBy(*by).agg(
        F.countDistinct(F.concat(F.col("date_day").cast("string"), F.lit("-"), F.col("pagePath"))).alias("page_views")
    )
    # stack the two one-row-per-entity aggregates and collapse them again:
    # no join needed, and the by=() case stays a plain global aggregate
    none = F.lit(None)
    st = s.select(*by, "sessions", "avg_bounce", none.cast("bigint").alias("page_views")).unionByName(
        p.select(*by, none.cast("bigint").alias("sessions"), none.cast("double").alias("avg_bounce"), "page_views")
    )
    j = st.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("sessions", "avg_bounce", "page_views")])
    b = F.col("avg_bounce")
    eng = F.when(b.isNull() | (b == 0), 0.5).otherwise(1.0 - b)
    return j.select(
        *by,
        nz("sessions").alias("sessions"),
        nz("page_views").alias("page_views"),
        F.floor(nz("sessions") * eng).cast("bigint").alias("engaged_sessions"),
        F.lit(0).cast("bigint").alias("conversions"),
    )


# fixed values: the web funnel steps (name, A13 count column) in order
WEB_FUNNEL = (("Session Started", "sessions"), ("Content Viewed", "page_views"),
              ("Engaged (CTA Click)", "engaged_sessions"), ("Conversion", "conversions"))


def funnel_steps_from_counts(counts: DataFrame, by: By = ()) -> DataFrame:
    """A13 -> W10 input: one row per funnel step (step, name, users) for each
    entity, from the A13 counts row (a 4-element explode, no join)."""
    arr = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(c).cast("bigint").alias("users"))
        for i, (name, c) in enumerate(WEB_FUNNEL)
    ])
    return counts.select(*by, F.explode(arr).alias("_s")).select(*by, "_s.*")


def event_totals(events: DataFrame, by: By = ()) -> DataFrame:
    """A14 (before top-k): per event name totals, days seen, events per user."""
    g = events.where(F.col("eventName").isNotNull()).groupBy(*by, F.col("eventName").alias("event_name")).agg(
        F.sum("eventCount").alias("total_events"),
        F.sum("totalUsers").alias("total_users"),
        F.countDistinct("date_day").alias("days_tracked"),
    )
    return g.withColumn("events_per_user", div("total_events", "total_users"))


# fixed values: session-duration buckets (label, upper bound in seconds, exclusive)
DURATION_BUCKETS = (("0-10s", 10), ("10-30s", 30), ("30-60s", 60), ("1-2min", 120), ("2-5min", 300), ("5min+", None))


def duration_buckets(pages: DataFrame, by: By = ()) -> DataFrame:
    """Page rows per duration bucket (``session_count``, COUNT(*) as in the
    reference) with its display order, the summed sessions, and the share of
    rows in the shortest bucket (per entity)."""
    d = F.col("averageSessionDuration")
    label = None
    order = None
    for i, (lab, hi) in enumerate(DURATION_BUCKETS):
        cond = d < hi if hi is not None else F.lit(True)
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
        order = F.when(cond, i + 1) if order is None else order.when(cond, i + 1)
    g = (
        pages.where(d.isNotNull())
        .groupBy(*by, label.alias("duration_bucket"), order.alias("bucket_order"))
        .agg(F.count(F.lit(1)).alias("session_count"), F.sum("sessions").alias("sessions"))
    )
    w = Window.partitionBy(*by) if by else Window.partitionBy()  # at most 6 rows per entity
    total = F.sum("session_count").over(w)
    short = F.sum(F.when(F.col("bucket_order") == 1, F.col("session_count")).otherwise(0)).over(w)
    return g.withColumn("short_share", div(short, total) * 100)


def new_vs_returning(sessions: DataFrame, by: By = ()) -> DataFrame:
    """returning = max(total - new, 0), % new."""
    g = sessions.groupBy(*by).agg(F.sum("users").alias("total_users"), F.sum("new_users").alias("new_users"))
    return g.withColumn("returning_users", F.greatest(F.col("total_users") - F.col("new_users"), F.lit(0))).withColumn(
        "new_pct", safe_divide("new_users", "total_users") * 100
    )


def device_breakdown(tech: DataFrame, by: By = ()) -> DataFrame:
    """Per device sums, pages/session and the entity's mobile share."""
    g = tech.where(F.col("deviceCategory").isNotNull()).groupBy(*by, F.col("deviceCategory").alias("device")).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("totalUsers").alias("users"),
        F.sum("screenPageViews").alias("page_views"),
    )
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    mob = F.sum(F.when(F.lower("device") == "mobile", F.col("sessions")).otherwise(0)).over(w)
    return (
        g.withColumn("pages_per_session", div("page_views", "sessions"))
        .withColumn("session_share", div(F.col("sessions") * 100, F.sum("sessions").over(w)))
        .withColumn("mobile_share", div(mob * 100, F.sum("sessions").over(w)))
    )


# fixed values: medium groups of the paid/organic split
PAID_MEDIUMS = ("cpc", "ppc", "paidsearch", "paid")
ORGANIC_MEDIUMS = ("organic", "referral", "direct", "(none)")


def paid_vs_organic(traffic: DataFrame, by: By = ()) -> DataFrame:
    """Paid / Organic / Other by medium (exact, case-sensitive match;
    NULL medium rows dropped)."""
    m = F.col("sessionMedium")
    grp = F.when(m.isin(*PAID_MEDIUMS), "Paid").when(m.isin(*ORGANIC_MEDIUMS), "Organic").otherwise("Other")
    return traffic.where(m.isNotNull()).groupBy(*by, grp.alias("traffic_type")).agg(
        F.sum("sessions").alias("sessions"),
        F.avg("bounceRate").alias("bounce_rate"),
        F.sum("screenPageViews").alias("page_views"),
    ).withColumn("engagement_rate", 1.0 - F.col("bounce_rate"))


def country_breakdown(geo: DataFrame, by: By = ()) -> DataFrame:
    """A19 + W12: per country sums, share of total and top-country concentration."""
    g = geo.where(F.col("country").isNotNull() & (F.col("country") != "(not set)")).groupBy(*by, "country").agg(
        F.sum("sessions").alias("sessions"), F.sum("totalUsers").alias("users"), F.sum("newUsers").alias("new_users")
    )
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tot = F.sum("sessions").over(w)
    return g.withColumn("share", div(F.col("sessions") * 100, tot)).withColumn(
        "concentration", div(F.max("sessions").over(w) * 100, tot)
    )


def web_daily_trend(sessions: DataFrame, by: By = ()) -> DataFrame:
    """Per day sessions, users, bounce, engagement %."""
    return sessions.groupBy(*by, "date_day").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("users").alias("users"),
        F.avg("bounce_rate").alias("bounce_rate"),
    ).withColumn("engagement_pct", (1.0 - F.col("bounce_rate")) * 100)


# ------------------------------------------------------------------ search / paid
def search_top(organic: DataFrame, dim: str, by: By = ()) -> DataFrame:
    """A22 (before top-k): clicks/impressions/avg position by query or page."""
    return organic.groupBy(*by, dim).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("position").alias("avg_position"),
    )


def paid_search_totals(ads: DataFrame, by: By = ()) -> DataFrame:
    """Σ metrics and AVG ctr (per-row ctr = clicks / impressions)."""
    return ads.groupBy(*by).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("spend").alias("cost"),
        F.sum("conversions").alias("conversions"),
        F.avg(div("clicks", "impressions")).alias("avg_ctr"),
    )


def _perf_cols(spend="spend", conv="conversions", value="conversion_value") -> list[Column]:
    return [
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum(spend).alias("cost"),
        F.sum(conv).alias("conversions"),
        F.sum(nz(value)).alias("conversion_value"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    """conv_rate, cpa (NULL w/o conversions), cpc, roas, ctr (else 0)."""
    return (
        df.withColumn("ctr", safe_divide("clicks", "impressions"))
        .withColumn("conv_rate", safe_divide("conversions", "clicks"))
        .withColumn("cpa", div("cost", "conversions"))
        .withColumn("cpc", safe_divide("cost", "clicks"))
        .withColumn("roas", safe_divide("conversion_value", "cost"))
    )


def campaign_performance(ads: DataFrame, by: By = ()) -> DataFrame:
    """A25 (before top-k): campaign totals, rates and AVG(row ctr)."""
    g = ads.groupBy(*by, "campaign_name", "campaign_type").agg(
        *_perf_cols(), F.avg(div("clicks", "impressions")).alias("avg_ctr")
    )
    return _rates(g)


def keyword_performance(ads: DataFrame, by: By = ()) -> DataFrame:
    """A26 (before top-k): keyword text x match type."""
    return _rates(ads.groupBy(*by, "keyword_text", "keyword_match_type").agg(*_perf_cols()))


def device_performance(ads: DataFrame, by: By = ()) -> DataFrame:
    """Per device (NULL device dropped) with rates; ``ctr`` is the
    unweighted AVG of the row click-through rates, as in the reference."""
    g = ads.where(F.col("device").isNotNull()).groupBy(*by, "device").agg(
        *_perf_cols(), F.avg(div("clicks", "impressions")).alias("_avg_ctr"))
    return _rates(g).withColumn("ctr", F.col("_avg_ctr")).drop("_avg_ctr")


def adgroup_performance(ads: DataFrame, by: By = ()) -> DataFrame:
    """A28 (before top-k): per campaign x ad group."""
    return _rates(ads.groupBy(*by, "campaign_name", "ad_group_name").agg(*_perf_cols()))


def geo_performance(ads: DataFrame, names: DataFrame, by: By = ()) -> DataFrame:
    """A29 + P11: per country criterion id, name from a small lookup with
    fallback 'Unknown (<id>)'. The fact side is aggregated first; the planner
    broadcasts the lookup when its size allows."""
    g = ads.where(F.col("country_criterion_id").isNotNull()).groupBy(*by, "country_criterion_id").agg(*_perf_cols())
    j = g.join(names, g.country_criterion_id == names.criterion_id, "left")
    nm = F.coalesce(F.col("country_name"), F.concat(F.lit("Unknown ("), F.col("country_criterion_id").cast("string"), F.lit(")")))
    return _rates(j.withColumn("country", nm).drop("criterion_id", "country_name"))


def hour_totals(hourly: DataFrame, by: By = ()) -> DataFrame:
    """Per hour of day (hour 0 kept)."""
    return hourly.where(F.col("hour").isNotNull()).groupBy(*by, "hour").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("cost").alias("cost"),
        F.sum("conversions").alias("conversions"),
    )


# ----------------------------------------------------------------------- social ads
def social_kpis(meta: DataFrame, by: By = ()) -> DataFrame:
    """Ratio-of-sums KPIs (ctr %, cpc, cpm, frequency, cpi, ROAS %), 0 when undefined."""
    g = meta.groupBy(*by).agg(
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("reach").alias("reach"),
        F.sum("clicks").alias("clicks"),
        F.sum(nz("app_installs")).alias("app_installs"),
        F.sum(nz("purchases")).alias("purchases"),
        F.sum(nz("conversion_value")).alias("revenue"),
    )
    return (
        g.withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions"))
        .withColumn("cpc", safe_divide("spend", "clicks"))
        .withColumn("cpm", safe_divide(F.col("spend") * 1000, "impressions"))
        .withColumn("frequency", safe_divide("impressions", "reach"))
        .withColumn("cpi", safe_divide("spend", "app_installs"))
        .withColumn("roas_pct", safe_divide("revenue", "spend") * 100)
    )


def social_kpis_periods(meta: DataFrame, cutoff, prev_cutoff, by: By = ()) -> DataFrame:
    """A31 with its comparison: current KPIs over ``date >= cutoff`` (P06) and
    the previous totals over ``prev_cutoff <= date < cutoff`` (P07), from ONE
    scan with conditional sums; deltas as F04a %-changes."""
    from mkpulse.functions import pct_change
    from mkpulse.functions.periods import half_open, since

    lo = since("date_day", prev_cutoff)
    cur, prev = since("date_day", cutoff), half_open("date_day", prev_cutoff, cutoff)

    def s2(c: str) -> list[Column]:
        e = nz(c)
        return [F.sum(F.when(cur, e)).alias(c), F.sum(F.when(prev, e)).alias(f"prev_{c}")]

    g = meta.where(lo).groupBy(*by).agg(
        *s2("spend"), *s2("impressions"), *s2("clicks"), *s2("app_installs"),
        F.sum(F.when(cur, F.col("reach"))).alias("reach"),
        F.sum(F.when(cur, nz("purchases"))).alias("purchases"),
        F.sum(F.when(cur, nz("conversion_value"))).alias("revenue"),
    )
    return (
        g.withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions"))
        .withColumn("cpc", safe_divide("spend", "clicks"))
        .withColumn("cpm", safe_divide(F.col("spend") * 1000, "impressions"))
        .withColumn("frequency", safe_divide("impressions", "reach"))
        .withColumn("cpi", safe_divide("spend", "app_installs"))
        .withColumn("roas_pct", safe_divide("revenue", "spend") * 100)
        .withColumn("spend_delta", pct_change("spend", "prev_spend"))
        .withColumn("clicks_delta", pct_change("clicks", "prev_clicks"))
        .withColumn("installs_delta", pct_change("app_installs", "prev_app_installs"))
    )


def social_daily(meta: DataFrame, by: By = ()) -> DataFrame:
    """Daily spend, clicks, impressions, installs with ctr %, cpc."""
    g = meta.groupBy(*by, "date_day").agg(
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum(nz("app_installs")).alias("app_installs"),
    )
    return g.withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions")).withColumn(
        "cpc", safe_divide("spend", "clicks")
    )


def social_campaigns(meta: DataFrame, by: By = (), level: str | Sequence[str] = "campaign_name") -> DataFrame:
    """Campaign (or ad set x campaign) table with reach, revenue,
    ctr %, cpc, cpm, cpi."""
    levels = [level] if isinstance(level, str) else list(level)
    g = meta.groupBy(*by, *levels).agg(
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("reach").alias("reach"),
        F.sum("clicks").alias("clicks"),
        F.sum(nz("app_installs")).alias("app_installs"),
        F.sum(nz("purchases")).alias("purchases"),
        F.sum(nz("conversion_value")).alias("revenue"),
    )
    return (
        g.withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions"))
        .withColumn("cpc", safe_divide("spend", "clicks"))
        .withColumn("cpm", safe_divide(F.col("spend") * 1000, "impressions"))
        .withColumn("cpi", safe_divide("spend", "app_installs"))
    )


def pivot_values(df: DataFrame, col_name: str, most: int = 10_000) -> list:
    """Every value of ``col_name``, sorted: the columns of a complete pivot.

    One value more than ``most`` raises: a matrix of that width is better kept
    in the long form, and leaving values out would lose their rows."""
    found = [r[0] for r in df.select(col_name).where(F.col(col_name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col_name} has more than {most} values; use the long form")
    return sorted(found)


def spend_by_campaign(meta: DataFrame, by: By = (), pivot_col: str = "campaign_name") -> DataFrame:
    """A34 long form: spend per day and campaign, any number of campaigns."""
    return meta.groupBy(*by, "date_day", pivot_col).agg(F.sum("spend").alias("spend"))


def spend_pivot(meta: DataFrame, names: Sequence[str] | None = None, by: By = (), pivot_col: str = "campaign_name") -> DataFrame:
    """Day x campaign spend matrix, NULL -> 0, a column for every campaign
    (``names`` selects some on the caller's wish); a NULL name is ``(none)``."""
    long = spend_by_campaign(meta.withColumn(pivot_col, F.coalesce(F.col(pivot_col), F.lit("(none)"))), by, pivot_col)
    if names is None:  # the fact is read once; names and matrix come from its days
        long = materialize(long, "spend-pivot")
        names = pivot_values(long, pivot_col)
    p = long.groupBy(*by, "date_day").pivot(pivot_col, list(names)).agg(F.sum("spend"))
    return p.fillna(0.0, subset=list(names))


def social_breakdown(rows: DataFrame, dims: Sequence[str], by: By = ()) -> DataFrame:
    """Sums per breakdown dimension(s) with ctr %, cpc, cpm."""
    g = rows.groupBy(*by, *dims).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("spend").alias("spend"),
        F.sum(nz("app_installs")).alias("app_installs"),
    )
    return (
        g.withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions"))
        .withColumn("cpc", safe_divide("spend", "clicks"))
        .withColumn("cpm", safe_divide(F.col("spend") * 1000, "impressions"))
    )


def social_rollup(rows: DataFrame, a: str, b: str, by: By = ()) -> DataFrame:
    """A x b plus each single-dimension roll-up in ONE aggregate
    (grouping sets, one shuffle); ``level`` names the grouping of each row."""
    by = list(by)
    g = rows.groupingSets([[*by, a, b], [*by, a], [*by, b]], *by, a, b).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("spend").alias("spend"),
        F.sum(nz("app_installs")).alias("app_installs"),
        F.grouping(a).alias("_ga"),
        F.grouping(b).alias("_gb"),
    )
    lvl = F.when((F.col("_ga") == 0) & (F.col("_gb") == 0), f"{a}_x_{b}").when(F.col("_gb") == 1, a).otherwise(b)
    return (
        g.withColumn("level", lvl).drop("_ga", "_gb")
        .withColumn("ctr", safe_divide(F.col("clicks") * 100, "impressions"))
        .withColumn("cpc", safe_divide("spend", "clicks"))
    )


# fixed values: display order of the age buckets
AGE_ORDER = ("13-17", "18-24", "25-34", "35-44", "45-54", "55-64", "65+")


def age_gender_matrix(rows: DataFrame, metric: str = "spend", by: By = ()) -> DataFrame:
    """A38 matrix: age rows x a column for every gender (a NULL one counts as
    ``unknown``) of summed spend, NULL -> 0, with the fixed age-bucket order."""
    long = rows.groupBy(*by, "age", F.coalesce(F.col("gender"), F.lit("unknown")).alias("gender")).agg(F.sum(metric).alias("_sum"))
    long = materialize(long, "age-gender")  # the rows are read once
    genders = pivot_values(long, "gender")
    p = long.groupBy(*by, "age").pivot("gender", genders).agg(F.sum("_sum"))
    return p.fillna(0, subset=genders).withColumn("age_order", order_key("age", AGE_ORDER))


# ---------------------------------------------------------------------- posts
def post_totals(posts: DataFrame, by: By = ()) -> DataFrame:
    """Count, Σ metrics, Σ engagements (likes + retweets + replies + quotes
    + bookmarks), AVG likes/retweets, engagement rate % over impressions (1
    when there are none, as in the reference)."""
    eng = F.col("likes") + F.col("retweets") + F.col("replies") + F.col("quotes") + F.col("bookmarks")
    g = posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.sum("impressions").alias("impressions"),
        F.sum("likes").alias("likes"),
        F.sum("retweets").alias("retweets"),
        F.sum("replies").alias("replies"),
        F.sum("quotes").alias("quotes"),
        F.sum("bookmarks").alias("bookmarks"),
        F.sum(eng).alias("engagements"),
        F.avg("likes").alias("avg_likes"),
        F.avg("retweets").alias("avg_retweets"),
    )
    imp = F.when(nz("impressions") == 0, F.lit(1)).otherwise(F.col("impressions"))
    return g.withColumn("engagement_rate", F.col("engagements") / imp * 100)


def post_types(posts: DataFrame, by: By = ()) -> DataFrame:
    """Per post type count, avg impressions / likes, avg_engagement."""
    g = posts.groupBy(*by, "tweet_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("impressions").alias("impressions"),
        F.sum("likes").alias("likes"),
        F.sum("retweets").alias("retweets"),
        F.avg("impressions").alias("avg_impressions"),
        F.avg("likes").alias("avg_likes"),
    )
    return g.withColumn("avg_engagement", F.col("avg_likes") + F.col("impressions") / F.col("count") * 0.01)


def post_daily(posts: DataFrame, by: By = ()) -> DataFrame:
    """Per created_date counts and sums, engagement rate rounded half-even."""
    eng = F.col("likes") + F.col("retweets") + F.col("replies") + F.col("quotes") + F.col("bookmarks")
    g = posts.groupBy(*by, "created_date").agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("likes").alias("total_likes"),
        F.sum("retweets").alias("total_retweets"),
        F.sum("replies").alias("total_replies"),
        F.sum(eng).alias("total_engagements"),
    )
    imp = F.when(F.col("total_impressions") == 0, 1).otherwise(F.col("total_impressions"))
    # half-even like numpy's round; the 9-digit step drops float noise first
    return g.withColumn("engagement_rate", F.bround(F.round(F.col("total_engagements") / imp * 100, 9), 2))


# -------------------------------------------------------------------- advanced
def keyword_campaign(ads: DataFrame, by: By = ()) -> DataFrame:
    """Keyword x match x campaign with conv_rate x100, HAVING impressions > 0."""
    g = ads.groupBy(*by, "keyword_text", "keyword_match_type", "campaign_name").agg(*_perf_cols())
    return g.where(F.col("impressions") > 0).withColumn(
        "conv_rate", safe_divide("conversions", "clicks") * 100
    ).withColumn("cpa", div("cost", "conversions"))


def match_type_summary(kw: DataFrame, by: By = ()) -> DataFrame:
    """Per match type over A43 rows: count, Σ, CPA."""
    g = kw.groupBy(*by, "keyword_match_type").agg(
        F.count(F.lit(1)).alias("keywords"),
        F.sum("cost").alias("cost"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
    )
    return g.withColumn("cpa", div("cost", "conversions"))


def quadrant_summary(q: DataFrame, by: By = ()) -> DataFrame:
    """Per quadrant count, Σspend, Σconversions, mean CPA."""
    return q.groupBy(*by, "quadrant").agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.sum("spend").alias("spend"),
        F.sum("conversions").alias("conversions"),
        F.avg("cpa").alias("avg_cpa"),
    )


def platform_spend(ads: DataFrame, by: By = ()) -> DataFrame:
    """Per platform totals stacked (UNION ALL shape via one groupBy)."""
    return ads.groupBy(*by, "platform").agg(
        F.sum("spend").alias("total_spend"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.sum(_conv()).alias("total_conversions"),
    )


def cross_platform_spend(paid: DataFrame, organic: DataFrame, by: By = ()) -> DataFrame:
    """A46 (documented form): total spend per paid platform UNION ALL one
    'organic' row with spend 0 when organic data exists (a one-row limit, the
    existence test of the reference)."""
    p = paid.groupBy(*by, "platform").agg(F.sum("spend").alias("total_spend"))
    o = organic.select(*by).limit(1) if not by else organic.select(*by).distinct()
    o = o.select(*by, F.lit("organic").alias("platform"), F.lit(0.0).alias("total_spend"))
    return p.unionByName(o)


def account_comparison(meta: DataFrame, by: By = ()) -> DataFrame:
    """Per account x campaign totals with the account's spend rank; an
    account may have any number of campaigns."""
    g = meta.groupBy(*by, "account_id", "campaign_name").agg(
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum(nz("app_installs")).alias("app_installs"),
    )
    entity = [*by, "account_id"]
    ranked = spread_rank(g, [F.desc("spend"), F.asc("campaign_name")], entity, "spend_rank")
    return ranked.join(ranked.groupBy(*entity).agg(F.sum("spend").alias("account_spend")), entity).select(*ranked.columns, "account_spend")


def status_counts(meta_objects: DataFrame, by: By = ()) -> DataFrame:
    """ACTIVE / PAUSED / other counts per account and object level."""
    return meta_objects.groupBy(*by, "account_id", "level").agg(
        F.count(F.when(F.col("status") == "ACTIVE", 1)).alias("active"),
        F.count(F.when(F.col("status") == "PAUSED", 1)).alias("paused"),
        F.count(F.lit(1)).alias("total"),
    )


def actual_cpc(ads: DataFrame, by: By = ()) -> DataFrame:
    """Σcost_micros / 1e6 / NULLIF(Σclicks, 0) per campaign."""
    g = ads.groupBy(*by, "campaign_name").agg(F.sum("cost_micros").alias("cost_micros"), F.sum("clicks").alias("clicks"))
    return g.withColumn("actual_cpc", div(F.col("cost_micros") / 1e6, "clicks"))


def source_revenue(traffic: DataFrame, revenue: str = "screenPageViews", by: By = ()) -> DataFrame:
    """A49 (before top-k): sessions and revenue per source/medium."""
    return traffic.groupBy(*by, F.col("sessionSource").alias("source"), F.col("sessionMedium").alias("medium")).agg(
        F.sum("sessions").alias("sessions"), F.sum(revenue).alias("revenue")
    )


def cost_per_install(meta: DataFrame, by: By = ()) -> DataFrame:
    """Per campaign cost per install (else 0)."""
    g = meta.groupBy(*by, "campaign_name").agg(F.sum("spend").alias("spend"), F.sum(nz("app_installs")).alias("installs"))
    return g.withColumn("cost_per_install", safe_divide("spend", "installs"))
