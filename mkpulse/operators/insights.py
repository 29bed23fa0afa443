"""Rule-based insights (N14-N25) and their inputs.

Each insight family first reduces its inputs to ONE fact row per entity (a
handful of aggregates, stacked and collapsed without joins), then evaluates
its rules as data: every rule is a condition plus an insight struct; the
matching structs are compacted into an array in rule order, optionally cut to
the first k, and exploded. So a rule set costs one pass over pre-aggregated
facts, for any number of entities, with nothing collected on the driver.

Insight record: ``source, rule_order, rule, priority, title, metric, value,
change, action``. Titles are fixed texts (direction included); the numbers
travel in ``value`` / ``change`` instead of being formatted into strings.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.functions import humanize, nz, pct_change, pct_change_abs
from mkpulse.functions.periods import as_date, tag_periods

By = Sequence[str]

# fixed values: priority order of the insight feed
PRIORITY_ORDER = ("critical", "high", "medium", "low", "info")


@dataclass
class Rule:
    rule: str
    priority: str | Column
    cond: Column
    title: str | Column
    metric: str
    value: Column | None = None
    change: Column | None = None
    action: str | Column | None = None


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def emit(facts: DataFrame, rules: Sequence[Rule], source: str, by: By = (), limit: int | None = None) -> DataFrame:
    """Evaluate ``rules`` on each fact row; one output row per firing rule."""
    items = []
    for i, r in enumerate(rules):
        s = F.struct(
            F.lit(i + 1).alias("rule_order"),
            F.lit(r.rule).alias("rule"),
            _lit(r.priority).cast("string").alias("priority"),
            _lit(r.title).cast("string").alias("title"),
            F.lit(r.metric).alias("metric"),
            (r.value if r.value is not None else F.lit(None)).cast("double").alias("value"),
            (r.change if r.change is not None else F.lit(None)).cast("double").alias("change"),
            _lit(r.action).cast("string").alias("action"),
        )
        items.append(F.when(F.coalesce(r.cond, F.lit(False)), s))
    arr = F.array_compact(F.array(*items))
    if limit is not None:
        arr = F.slice(arr, 1, limit)
    return facts.select(*by, F.explode(arr).alias("_i")).select(*by, F.lit(source).alias("source"), "_i.*")


def stack_rows(frames: Sequence[DataFrame], by: By = ()) -> DataFrame:
    """Combine one-row-per-entity frames with distinct columns into one row per
    entity: stack them (missing columns NULL) and collapse with ``max`` - one
    aggregate, no join, also for ``by=()``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in by]
    return out.groupBy(*by).agg(*[F.max(c).alias(c) for c in cols])


def truthy(c: str | Column) -> Column:
    """Python truthiness of a number: not NULL and not 0."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & (x != 0)


# ----------------------------------------------------------------------- A42
def insight_inputs(ads: DataFrame, as_of, days: int = 7, by: By = ()) -> DataFrame:
    """Daily sums of cost / clicks / conversions / impressions for
    ``date >= as_of - days`` (a pushed-down range filter)."""
    cutoff = as_date(as_of) - dt.timedelta(days=days)
    return (
        ads.where(F.col("date_day") >= F.lit(cutoff))
        .groupBy(*by, "date_day")
        .agg(
            F.sum("spend").alias("cost"),
            F.sum("clicks").alias("clicks"),
            F.sum("conversions").alias("conversions"),
            F.sum("impressions").alias("impressions"),
        )
    )


# ----------------------------------------------------------------------- N14/N15
def exec_facts(paid: DataFrame, organic: DataFrame, cur: tuple, prev: tuple, by: By = ()) -> DataFrame:
    """One fact row per entity: paid and organic totals of both periods and the
    current period's top channel by spend."""
    conv = nz("conversions") + nz("app_installs")
    tp = tag_periods(paid, "date_day", cur, prev)
    c, p = F.col("period") == "current", F.col("period") == "previous"
    # one aggregate by channel feeds the totals and the top channel: the paid fact is read once
    ch = tp.groupBy(*by, "platform").agg(
        F.sum(F.when(c, F.col("spend"))).alias("spend_cur"),
        F.sum(F.when(p, F.col("spend"))).alias("spend_prev"),
        F.sum(F.when(c, conv)).alias("conversions_cur"),
        F.sum(F.when(p, conv)).alias("conversions_prev"),
        F.count(F.when(c, 1)).alias("_rows"),
    )
    now = F.col("_rows") > 0
    cpa = F.when(F.col("conversions_cur") > 0, F.col("spend_cur") / F.col("conversions_cur")).alias("cpa")
    k = ch.groupBy(*by).agg(
        *[F.sum(x).alias(x) for x in ("spend_cur", "spend_prev", "conversions_cur", "conversions_prev")],
        F.count(F.when(now, 1)).alias("n_channels"),
        F.max_by(F.struct("platform", "spend_cur", cpa), F.when(now, F.struct("spend_cur", "platform"))).alias("_top"),
    )
    k = k.select(*[x for x in k.columns if x != "_top"], F.col("_top.platform").alias("top_channel"),
                 F.col("_top.spend_cur").alias("top_spend"), F.col("_top.cpa").alias("top_cpa"))
    to = tag_periods(organic, "date_day", cur, prev)
    o = to.groupBy(*by).agg(
        F.sum(F.when(c, F.col("clicks"))).alias("organic_cur"), F.sum(F.when(p, F.col("clicks"))).alias("organic_prev")
    )
    f = stack_rows([k, o], by)
    return (
        f.withColumn("spend_delta", pct_change("spend_cur", "spend_prev"))
        .withColumn("conversions_delta", pct_change("conversions_cur", "conversions_prev"))
        .withColumn("organic_delta", pct_change("organic_cur", "organic_prev"))
        .withColumn("cpa_cur", F.when(F.col("conversions_cur") > 0, F.col("spend_cur") / F.col("conversions_cur")))
        .withColumn("cpa_prev", F.when(F.col("conversions_prev") > 0, F.col("spend_prev") / F.col("conversions_prev")))
        .withColumn("cpa_delta", pct_change("cpa_cur", "cpa_prev"))
    )


def exec_insights(facts: DataFrame, by: By = (), limit: int = 4) -> DataFrame:
    """Change > 10% in spend, conversions, organic clicks, CPA; the top
    channel when there is more than one and its CPA > 0; first ``limit``."""
    sd, cd, od, ad = (F.col(x) for x in ("spend_delta", "conversions_delta", "organic_delta", "cpa_delta"))
    rules = [
        Rule("spend_change", "info", truthy("spend_cur") & truthy("spend_prev") & truthy(sd) & (F.abs(sd) > 10),
             F.when(sd > 0, "Paid spend increased").otherwise("Paid spend decreased"), "spend", F.col("spend_cur"), sd,
             F.when(sd > 20, "Compare spend with plan before the next cycle").otherwise("No step needed, look again next period")),
        Rule("conversion_change", "info",
             truthy("conversions_cur") & truthy("conversions_prev") & truthy(cd) & (F.abs(cd) > 10),
             F.when(cd > 0, "Conversions up").otherwise("Conversions down"), "conversions", F.col("conversions_cur"), cd,
             F.when(cd > 0, "Move budget toward what converted").otherwise("Find which campaigns lost conversions")),
        Rule("organic_change", "info", truthy("organic_cur") & truthy("organic_prev") & truthy(od) & (F.abs(od) > 10),
             F.when(od > 0, "Organic clicks growing").otherwise("Organic clicks declining"), "organic_clicks",
             F.col("organic_cur"), od, F.when(od > 0, "Keep publishing on the pages that gained").otherwise("List the queries whose position fell")),
        Rule("cpa_change", "info",
             truthy("spend_cur") & F.col("cpa_cur").isNotNull() & truthy("spend_prev") & F.col("cpa_prev").isNotNull()
             & truthy(ad) & (F.abs(ad) > 10),
             F.when(ad > 0, "CPA increased").otherwise("CPA improved"), "cpa", F.col("cpa_cur"), ad,
             F.when(ad > 0, "Narrow the audiences that convert at a high cost").otherwise("There is room to spend more at this cost")),
        Rule("top_channel", "info", (F.col("n_channels") > 1) & (F.col("top_cpa") > 0),
             F.concat(humanize("top_channel"), F.lit(" leads spend")), "spend", F.col("top_spend"), None,
             "Put cost per conversion of all channels side by side"),
    ]
    return emit(facts, rules, "executive", by, limit)


def risk_signals(facts: DataFrame, cpa_target: float = 5.0, budget: float = 10000.0, conversions_target: float = 1000.0,
                 by: By = ()) -> DataFrame:
    """Spend outgrowing conversions, CPA > 1.2 x target, budget > 90%
    used, conversion target reached."""
    sg, cg = nz("spend_delta", 0.0), nz("conversions_delta", 0.0)
    cpa = F.col("spend_cur") / F.col("conversions_cur")
    util = F.col("spend_cur") / F.lit(float(budget))
    prog = F.col("conversions_cur") / F.lit(float(conversions_target))
    all4 = truthy("spend_cur") & truthy("spend_prev") & truthy("conversions_cur") & truthy("conversions_prev")
    rules = [
        Rule("spend_outgrows_conversions", "warning", all4 & (sg > 10) & (cg < sg - 10),
             "Spend outpaces conversions", "spend", sg, cg),
        Rule("cpa_above_target", "warning", truthy("spend_cur") & (F.col("conversions_cur") > 0) & (cpa > cpa_target * 1.2),
             "CPA above target", "cpa", cpa, (cpa / cpa_target - 1) * 100),
        Rule("budget_utilization", "warning", truthy("spend_cur") & F.lit(budget > 0) & (util > 0.9),
             "Budget nearly used", "spend", util * 100),
        Rule("conversion_target_met", "success", truthy("conversions_cur") & F.lit(conversions_target > 0) & (prog >= 1.0),
             "Conversions have reached their goal", "conversions", prog * 100),
    ]
    return emit(facts, rules, "risk", by)


# ----------------------------------------------------------------------- N16/N17
def web_quick_insights(summary: DataFrame, by: By = ()) -> DataFrame:
    """N16 on the A09 summary row."""
    e = F.col("engagement_rate")
    nd = F.col("new_users_delta")
    b = nz("avg_bounce_rate", 0.0)
    rules = [
        Rule("low_engagement", "warning", e < 0.3, "Low Engagement", "engagement_rate", e),
        Rule("strong_engagement", "success", e > 0.7, "Strong Engagement", "engagement_rate", e),
        Rule("new_user_drop", "warning", truthy(nd) & (nd < -10), "New User Drop", "new_users", F.col("new_users"), nd),
        Rule("new_user_growth", "success", truthy(nd) & (nd > 20), "New User Growth", "new_users", F.col("new_users"), nd),
        Rule("high_bounce", "error", b > 0.7, "High Bounce Rate", "bounce_rate", b),
    ]
    return emit(summary, rules, "web", by)


def trend_diagnosis(split: DataFrame, by: By = ()) -> DataFrame:
    """N17 on W06 output: the first matching pattern only."""
    s, e = F.col("sessions_change"), F.col("engagement_rate_change")
    both = truthy(s) & truthy(e)
    rules = [
        Rule("intent_problem", "warning", both & (s > 10) & (e < -5), "Sessions up, engagement down: intent problem", "sessions", s, e),
        Rule("regression", "error", both & (s < -10) & (e < -5), "Sessions and engagement down: UX or content regression", "sessions", s, e),
        Rule("healthy_growth", "success", both & (s > 10) & (e > 5), "Healthy growth", "sessions", s, e),
        Rule("quality_over_quantity", "info", both & (s < 0) & (e > 0), "Fewer visits, more engaged", "sessions", s, e),
    ]
    return emit(split, rules, "web_trend", by, limit=1)


# ----------------------------------------------------------------------- N18
def what_changed(sessions_raw: DataFrame, traffic: DataFrame, tech: DataFrame, cur: tuple, prev: tuple,
                 by: By = (), limit: int = 6) -> DataFrame:
    """Sessions > 10%, bounce > 5%, each top-5 source/medium > 20% and
    each device > 15% change between the periods (rows present in both);
    the first ``limit`` in that order."""
    from mkpulse.functions import safe_float, safe_int, to_day

    s = tag_periods(sessions_raw.withColumn("date_day", to_day("date")), "date_day", cur, prev)
    c, p = F.col("period") == "current", F.col("period") == "previous"
    tot = s.groupBy(*by).agg(
        nz(F.sum(F.when(c, safe_int("sessions", None))), 0).alias("cur_s"),
        nz(F.sum(F.when(p, safe_int("sessions", None))), 0).alias("prev_s"),
        nz(F.avg(F.when(c, safe_float("bounceRate", None))), 0.0).alias("cur_b"),
        nz(F.avg(F.when(p, safe_float("bounceRate", None))), 0.0).alias("prev_b"),
    )
    sc = pct_change_abs("cur_s", "prev_s")
    bc = pct_change_abs("cur_b", "prev_b")
    head = tot.select(
        *by,
        F.array_compact(F.array(
            F.when(truthy(sc) & (F.abs(sc) > 10), F.struct(
                F.lit(1).alias("grp"), F.lit(1).alias("ord"),
                F.when(sc > 0, "Sessions up").otherwise("Sessions down").alias("title"),
                F.lit("sessions").alias("metric"), F.col("cur_s").cast("double").alias("value"), sc.alias("change"),
                F.when(sc > 0, "success").otherwise("warning").alias("severity"))),
            F.when(truthy(bc) & (F.abs(bc) > 5), F.struct(
                F.lit(2).alias("grp"), F.lit(1).alias("ord"),
                F.when(bc > 0, "More visits end on the first page").otherwise("Fewer visits end on the first page").alias("title"),
                F.lit("bounce_rate").alias("metric"), F.col("cur_b").cast("double").alias("value"), bc.alias("change"),
                F.when(bc > 0, "warning").otherwise("success").alias("severity"))),
        )).alias("_a"),
    ).select(*by, F.explode("_a").alias("_i")).select(*by, "_i.*")

    # both periods' top-5 source/medium from ONE aggregate (rank per period)
    tt5 = tag_periods(traffic.where(F.col("sessionSource").isNotNull() & F.col("sessionMedium").isNotNull()),
                      "date_day", cur, prev)
    g = tt5.groupBy(*by, "period", F.concat_ws(" / ", "sessionSource", "sessionMedium").alias("source_medium")).agg(
        F.sum("sessions").alias("sessions"))
    w5 = Window.partitionBy(*by, "period").orderBy(F.desc("sessions"), F.asc("source_medium"))
    ranked = g.withColumn("rk", F.row_number().over(w5)).where(F.col("rk") <= 5)
    cs = ranked.where(F.col("period") == "current").drop("period")
    ps = ranked.where(F.col("period") == "previous").select(*by, "source_medium", F.col("sessions").alias("prev"))
    srcj = cs.join(ps, [*by, "source_medium"])
    ch = pct_change_abs("sessions", "prev")
    src = srcj.where(truthy(ch) & (F.abs(ch) > 20)).select(
        *by, F.lit(3).alias("grp"), F.col("rk").alias("ord"),
        F.concat("source_medium", F.when(ch > 0, F.lit(" traffic up")).otherwise(F.lit(" traffic down"))).alias("title"),
        F.lit("sessions").alias("metric"), F.col("sessions").cast("double").alias("value"), ch.alias("change"),
        F.lit("info").alias("severity"),
    )

    tt = tag_periods(tech.where(F.col("deviceCategory").isNotNull()), "date_day", cur, prev)
    dv = tt.groupBy(*by, F.col("deviceCategory").alias("device")).agg(
        F.sum(F.when(c, F.col("sessions"))).alias("cur"), F.sum(F.when(p, F.col("sessions"))).alias("prev")
    ).where(F.col("cur").isNotNull() & F.col("prev").isNotNull())
    dc = pct_change_abs("cur", "prev")
    dev = dv.where(truthy(dc) & (F.abs(dc) > 15)).select(
        *by, F.lit(4).alias("grp"),
        F.row_number().over(Window.partitionBy(*by).orderBy("device")).alias("ord"),
        F.concat(F.initcap("device"), F.when(dc > 0, F.lit(" traffic up")).otherwise(F.lit(" traffic down"))).alias("title"),
        F.lit("sessions").alias("metric"), F.col("cur").cast("double").alias("value"), dc.alias("change"),
        F.lit("info").alias("severity"),
    )
    allr = head.unionByName(src).unionByName(dev)
    w = Window.partitionBy(*by).orderBy("grp", "ord")
    r = allr.withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= limit).drop("grp", "ord")


def what_changed_actions(changes: DataFrame, by: By = (), limit: int = 5) -> DataFrame:
    """N18 actions derived from the insight titles: distinct, at most ``limit``
    (alphabetical, as the reference's order is a set's)."""
    t = F.lower("title")
    first = F.element_at(F.split("title", " "), 1)
    act = (
        F.when(t.contains("more visits end on the first page"), F.lit("List the releases of this period and test the affected pages"))
        .when(t.contains("traffic down"), F.concat(F.lit("Find out why "), first, F.lit(" sends fewer visits")))
        .when(t.contains("traffic up"), F.concat(F.lit("Repeat what worked for "), first))
    )
    a = changes.select(*by, act.alias("action")).where(F.col("action").isNotNull()).distinct()
    w = Window.partitionBy(*by).orderBy("action")
    return a.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


# ----------------------------------------------------------------------- N19
def segment_facts(traffic: DataFrame, tech: DataFrame, geo: DataFrame, sessions: DataFrame, pages: DataFrame,
                  by: By = ()) -> DataFrame:
    """One row per entity: paid/organic engagement, mobile share, country
    concentration, new-user share, short-session share."""
    from mkpulse.operators.aggregates import ORGANIC_MEDIUMS, PAID_MEDIUMS

    m = F.col("sessionMedium")  # exact match, as in A18
    po = traffic.where(m.isNotNull()).groupBy(*by).agg(
        (1.0 - F.avg(F.when(m.isin(*PAID_MEDIUMS), F.col("bounceRate")))).alias("paid_engagement"),
        (1.0 - F.avg(F.when(m.isin(*ORGANIC_MEDIUMS), F.col("bounceRate")))).alias("organic_engagement"),
    )
    mob = tech.where(F.col("deviceCategory").isNotNull()).groupBy(*by).agg(
        (nz(F.sum(F.when(F.lower("deviceCategory") == "mobile", F.col("sessions"))), 0) * 100.0
         / F.nullif(F.sum("sessions"), F.lit(0))).alias("mobile_pct")
    )
    cg = geo.where(F.col("country").isNotNull() & (F.col("country") != "(not set)")).groupBy(*by, "country").agg(
        F.sum("sessions").alias("s")
    )
    con = cg.groupBy(*by).agg((F.max("s") * 100.0 / F.nullif(F.sum("s"), F.lit(0))).alias("concentration"))
    nu = sessions.groupBy(*by).agg(
        nz(F.sum("new_users") * 100.0 / F.nullif(F.sum("users"), F.lit(0)), 0.0).alias("new_pct")
    )
    d = F.col("averageSessionDuration")
    sh = pages.where(d.isNotNull()).groupBy(*by).agg(  # share of page rows under 10 s (row counts, as in A15)
        nz(F.count(F.when(d < 10, 1)) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 0.0).alias("short_pct")
    )
    return stack_rows([po, mob, con, nu, sh], by)


def segment_insights(facts: DataFrame, by: By = ()) -> DataFrame:
    """N19 rules."""
    pe, oe = F.col("paid_engagement"), F.col("organic_engagement")
    mp, cc, npct, sp = F.col("mobile_pct"), F.col("concentration"), F.col("new_pct"), F.col("short_pct")
    rules = [
        Rule("paid_lags_organic", "warning", pe < oe - 0.1, "Paid engagement lags organic", "engagement_rate", pe, pe - oe),
        Rule("paid_beats_organic", "success", pe > oe + 0.1, "Paid engagement beats organic", "engagement_rate", pe, pe - oe),
        Rule("mobile_heavy", "info", mp > 60, "Phones bring most visits", "mobile_pct", mp),
        Rule("desktop_heavy", "info", mp < 20, "Most visits come from desktops", "mobile_pct", mp),
        Rule("mobile_majority", "warning", mp > 50, "Phones bring most visits", "mobile_pct", mp),
        Rule("country_concentration", "info", cc > 80, "Traffic highly concentrated", "concentration", cc),
        Rule("high_new_users", "warning", npct > 80, "High new user share", "new_pct", npct),
        Rule("strong_retention", "success", npct < 30, "Strong retention", "new_pct", npct),
        Rule("short_sessions", "warning", sp > 50, "Most sessions under 10 seconds", "short_pct", sp),
        Rule("engaged_sessions", "success", sp < 20, "Few sessions under 10 seconds", "short_pct", sp),
    ]
    return emit(facts, rules, "segments", by)


# ----------------------------------------------------------------------- N20-N23
def search_ads_daily_insights(daily: DataFrame, by: By = ()) -> DataFrame:
    """N20 on W04 output (last vs previous day)."""
    sc, cc = F.col("cost_change"), F.col("conversions_change")
    rules = [
        Rule("gads_spend", "critical", (F.col("prev_cost") > 0) & (F.abs(sc) >= 0.80),
             F.when(sc > 0, "Google Ads spend increased").otherwise("Google Ads spend decreased"), "cost", F.col("cost"), sc,
             "Look for campaigns that raised bids or daily limits"),
        Rule("gads_conversions_drop", "high", (F.col("prev_conversions") > 0) & (cc <= -0.20),
             "Search-ads conversions fell from the day before", "conversions", F.col("conversions"), cc,
             "Confirm that tags fire and landing pages load"),
        Rule("gads_conversions_up", "medium", (F.col("prev_conversions") > 0) & (cc >= 0.20),
             "Search-ads conversions rose from the day before", "conversions", F.col("conversions"), cc),
    ]
    return emit(daily, rules, "gads", by)


def organic_weekly_insights(weeks: DataFrame, by: By = ()) -> DataFrame:
    """N21 on W05 output (first 7 vs last 7 rows)."""
    wc = F.col("week_change")
    pr = F.when(F.abs(wc) >= 0.50, "high").otherwise("medium")
    rules = [
        Rule("gsc_weekly", pr, (F.col("last_week") > 0) & (F.abs(wc) >= 0.20),
             F.when(wc > 0, "Organic search clicks up week-over-week").otherwise("Organic search clicks down week-over-week"),
             "clicks", F.col("this_week"), wc),
    ]
    return emit(weeks, rules, "gsc", by)


def social_daily_insights(daily: DataFrame, by: By = ()) -> DataFrame:
    """N22 on W04 output over (spend, installs): CPI up >= 20%."""
    lc = F.col("spend") / F.col("installs")
    pc = F.col("prev_spend") / F.col("prev_installs")
    ch = (lc - pc) / pc
    ok = (F.col("installs") > 0) & (F.col("prev_installs") > 0)
    rules = [
        Rule("meta_cpi", "high", ok & (F.when(ok, ch) >= 0.20), "Each social-ads install costs more", "cpi", F.when(ok, lc), F.when(ok, ch),
             "Sort ads by cost per result and pause the worst"),
    ]
    return emit(daily, rules, "meta", by)


def merge_insights(frames: Sequence[DataFrame], by: By = ()) -> DataFrame:
    """Union of the sources' insights, ordered by priority (critical
    first), stable within a priority by source order then rule order."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn("_src", F.lit(i))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    pr = F.lit(len(PRIORITY_ORDER))
    for i, p in reversed(list(enumerate(PRIORITY_ORDER))):
        pr = F.when(F.col("priority") == p, F.lit(i)).otherwise(pr)
    out = out.withColumn("priority_rank", pr)
    w = Window.partitionBy(*by).orderBy("priority_rank", "_src", "rule_order")
    return out.withColumn("position", F.row_number().over(w)).drop("_src")


# ----------------------------------------------------------------------- N24
def social_strategic_insights(kpis: DataFrame, by: By = ()) -> DataFrame:
    """N24 on the A31 KPI row (only when spend is non-zero)."""
    on = truthy("spend")
    ctr, fq, cpi = nz("ctr", 0.0), nz("frequency", 0.0), nz("cpi", 0.0)
    inst = nz("app_installs", 0)
    sp, cl = nz("spend", 0.0), nz("clicks", 0)
    rules = [
        Rule("low_ctr", "warning", on & (ctr < 0.5), "Low CTR Alert", "ctr", ctr),
        Rule("strong_ctr", "success", on & (ctr > 1.5), "Strong CTR", "ctr", ctr),
        Rule("high_frequency", "warning", on & (fq > 3), "People see the ads too often", "frequency", fq),
        Rule("cpi_high", "warning", on & (inst > 0) & (cpi > 5), "Each install costs too much", "cpi", cpi),
        Rule("cpi_efficient", "success", on & (inst > 0) & (cpi < 2), "Efficient CPI", "cpi", cpi),
        Rule("budget_efficiency", "info", on & (sp > 0) & (cl > 0) & (cl / sp < 0.5), "Budget Efficiency", "clicks_per_spend", cl / sp),
    ]
    return emit(kpis, rules, "social", by)


# ----------------------------------------------------------------------- N25
def freshness(last_dates: DataFrame, as_of, by: By = ()) -> DataFrame:
    """N25 on rows (source, last_date): days since the last date and status
    ok (<= 2), warning (<= 5), error; NULL last date -> no_data."""
    d = F.datediff(F.lit(as_date(as_of)), F.col("last_date"))
    st = F.when(F.col("last_date").isNull(), "no_data").when(d <= 2, "ok").when(d <= 5, "warning").otherwise("error")
    return last_dates.withColumn("days_ago", d).withColumn("status", st)


def last_date(df: DataFrame, source: str, date_col: str, by: By = ()) -> DataFrame:
    """N25 input: MAX(date) of one source (either date format), one row even
    when the source is empty."""
    from mkpulse.functions import to_day

    return df.groupBy(*by).agg(F.max(to_day(date_col)).alias("last_date")).select(*by, F.lit(source).alias("source"), "last_date")
