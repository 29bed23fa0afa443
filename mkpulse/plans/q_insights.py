"""Registered queries: rule-based insights N14-N25."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse.functions.periods import comparison_range, preset_range
from mkpulse.operators import aggregates as A
from mkpulse.operators import insights as I
from mkpulse.operators import windows as W
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import REGISTRY, DS, R, register
from mkpulse.plans.q_aggregates import _CUR, _PREV, _WCUR, _WPREV, CONV, EV_ASOF, LI_ASOF, _between
from mkpulse.plans import q_analytics  # noqa: F401  (registers the queries wrapped below)


def T(x: str) -> str:
    """SQL truthiness of a number."""
    return f"(({x}) IS NOT NULL AND ({x}) <> 0)"


def PCT(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN ({cur} - {prev}) / {prev} * 100 END"


def INITCAP(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace(lower({x}), '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def rules_sql(facts: str, rules: list[tuple], source: str, limit: int | None = None) -> str:
    """Rules as UNION ALL of one filtered SELECT each (the oracle twin of
    ``insights.emit``). Rule tuple: (rule, priority, cond, title, metric,
    value, change, action) with SQL expressions."""
    parts = []
    for i, (rule, prio, cond, title, metric, value, change, action) in enumerate(rules):
        parts.append(
            f"SELECT {i + 1} AS rule_order, '{rule}' AS rule, CAST({prio} AS VARCHAR) AS priority, "
            f"CAST({title} AS VARCHAR) AS title, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, "
            f"CAST({change} AS DOUBLE) AS change, CAST({action} AS VARCHAR) AS action FROM {facts} "
            f"WHERE COALESCE({cond}, FALSE)"
        )
    body = "\n  UNION ALL ".join(parts)
    inner = f"SELECT * FROM ({body})"
    if limit is not None:
        inner = f"SELECT * FROM ({body}) QUALIFY ROW_NUMBER() OVER (ORDER BY rule_order) <= {limit}"
    return (f"SELECT '{source}' AS source, rule_order, rule, priority, title, metric, {R('value')} AS value, "
            f"{R('change')} AS change, action FROM ({inner})")


def _q(name: str) -> str:
    return REGISTRY[name].sql


# ------------------------------------------------------------------- N14 / N15
_C, _P = _between("date_day", _CUR), _between("date_day", _PREV)
_EXEC_FACTS = f"""
k AS (SELECT SUM(CASE WHEN {_C} THEN spend END) AS spend_cur, SUM(CASE WHEN {_P} THEN spend END) AS spend_prev,
  SUM(CASE WHEN {_C} THEN {CONV} END) AS conversions_cur, SUM(CASE WHEN {_P} THEN {CONV} END) AS conversions_prev
  FROM ads_lean WHERE date_day BETWEEN DATE '{_PREV[0]}' AND DATE '{_CUR[1]}'),
chg AS (SELECT platform, SUM(spend) AS spend, CASE WHEN SUM({CONV}) > 0 THEN SUM(spend) / SUM({CONV}) END AS cpa
  FROM ads_lean WHERE {_C} GROUP BY platform),
top AS (SELECT platform AS top_channel, spend AS top_spend, cpa AS top_cpa FROM chg ORDER BY spend DESC, platform DESC LIMIT 1),
o AS (SELECT SUM(CASE WHEN {_C} THEN clicks END) AS organic_cur, SUM(CASE WHEN {_P} THEN clicks END) AS organic_prev
  FROM organic WHERE date_day BETWEEN DATE '{_PREV[0]}' AND DATE '{_CUR[1]}'),
f0 AS (SELECT k.*, (SELECT COUNT(*) FROM chg) AS n_channels, top.*, o.* FROM k, top, o),
f1 AS (SELECT *, {PCT('spend_cur', 'spend_prev')} AS spend_delta, {PCT('conversions_cur', 'conversions_prev')} AS conversions_delta,
  {PCT('organic_cur', 'organic_prev')} AS organic_delta,
  CASE WHEN conversions_cur > 0 THEN spend_cur / conversions_cur END AS cpa_cur,
  CASE WHEN conversions_prev > 0 THEN spend_prev / conversions_prev END AS cpa_prev FROM f0),
facts AS (SELECT *, {PCT('cpa_cur', 'cpa_prev')} AS cpa_delta FROM f1)"""


def _exec_facts(t):
    return I.exec_facts(ad.ads(t, dims=False), ad.organic(t), _CUR, _PREV)


_N14_RULES = [
    ("spend_change", "'info'", f"{T('spend_cur')} AND {T('spend_prev')} AND {T('spend_delta')} AND abs(spend_delta) > 10",
     "CASE WHEN spend_delta > 0 THEN 'Paid spend increased' ELSE 'Paid spend decreased' END", "spend", "spend_cur",
     "spend_delta", "CASE WHEN spend_delta > 20 THEN 'Compare spend with plan before the next cycle' ELSE 'No step needed, look again next period' END"),
    ("conversion_change", "'info'",
     f"{T('conversions_cur')} AND {T('conversions_prev')} AND {T('conversions_delta')} AND abs(conversions_delta) > 10",
     "CASE WHEN conversions_delta > 0 THEN 'Conversions up' ELSE 'Conversions down' END", "conversions", "conversions_cur",
     "conversions_delta", "CASE WHEN conversions_delta > 0 THEN 'Move budget toward what converted' ELSE 'Find which campaigns lost conversions' END"),
    ("organic_change", "'info'", f"{T('organic_cur')} AND {T('organic_prev')} AND {T('organic_delta')} AND abs(organic_delta) > 10",
     "CASE WHEN organic_delta > 0 THEN 'Organic clicks growing' ELSE 'Organic clicks declining' END", "organic_clicks",
     "organic_cur", "organic_delta", "CASE WHEN organic_delta > 0 THEN 'Keep publishing on the pages that gained' ELSE 'List the queries whose position fell' END"),
    ("cpa_change", "'info'",
     f"{T('spend_cur')} AND cpa_cur IS NOT NULL AND {T('spend_prev')} AND cpa_prev IS NOT NULL AND {T('cpa_delta')} AND abs(cpa_delta) > 10",
     "CASE WHEN cpa_delta > 0 THEN 'CPA increased' ELSE 'CPA improved' END", "cpa", "cpa_cur", "cpa_delta",
     "CASE WHEN cpa_delta > 0 THEN 'Narrow the audiences that convert at a high cost' ELSE 'There is room to spend more at this cost' END"),
    ("top_channel", "'info'", "n_channels > 1 AND top_cpa > 0", f"{INITCAP('top_channel')} || ' leads spend'", "spend",
     "top_spend", "NULL", "'Put cost per conversion of all channels side by side'"),
]


@register("n14_exec_insights", f"WITH {_EXEC_FACTS}\n" + rules_sql("facts", _N14_RULES, "executive", 4),
          ["ads_lean", "organic"])
def n14(t):
    return I.exec_insights(_exec_facts(t))


_SG, _CG = "COALESCE(spend_delta, 0.0)", "COALESCE(conversions_delta, 0.0)"
_N15_RULES = [
    ("spend_outgrows_conversions", "'warning'",
     f"{T('spend_cur')} AND {T('spend_prev')} AND {T('conversions_cur')} AND {T('conversions_prev')} AND {_SG} > 10 AND {_CG} < {_SG} - 10",
     "'Spend outpaces conversions'", "spend", _SG, _CG, "NULL"),
    ("cpa_above_target", "'warning'", f"{T('spend_cur')} AND conversions_cur > 0 AND spend_cur / conversions_cur > 6.0",
     "'CPA above target'", "cpa", "spend_cur / conversions_cur", "(spend_cur / conversions_cur / 5.0 - 1) * 100", "NULL"),
    ("budget_utilization", "'warning'", f"{T('spend_cur')} AND spend_cur / 10000.0 > 0.9", "'Budget nearly used'", "spend",
     "spend_cur / 10000.0 * 100", "NULL", "NULL"),
    ("conversion_target_met", "'success'", f"{T('conversions_cur')} AND conversions_cur / 1000.0 >= 1.0",
     "'Conversions have reached their goal'", "conversions", "conversions_cur / 1000.0 * 100", "NULL", "NULL"),
]


@register("n15_risk_signals", f"WITH {_EXEC_FACTS}\n" + rules_sql("facts", _N15_RULES, "risk"), ["ads_lean", "organic"])
def n15(t):
    return I.risk_signals(_exec_facts(t))


# ------------------------------------------------------------------- N16 / N17
_N16_RULES = [
    ("low_engagement", "'warning'", "engagement_rate < 0.3", "'Low Engagement'", "engagement_rate", "engagement_rate", "NULL", "NULL"),
    ("strong_engagement", "'success'", "engagement_rate > 0.7", "'Strong Engagement'", "engagement_rate", "engagement_rate", "NULL", "NULL"),
    ("new_user_drop", "'warning'", f"{T('new_users_delta')} AND new_users_delta < -10", "'New User Drop'", "new_users",
     "new_users", "new_users_delta", "NULL"),
    ("new_user_growth", "'success'", f"{T('new_users_delta')} AND new_users_delta > 20", "'New User Growth'", "new_users",
     "new_users", "new_users_delta", "NULL"),
    ("high_bounce", "'error'", "COALESCE(avg_bounce_rate, 0.0) > 0.7", "'High Bounce Rate'", "bounce_rate",
     "COALESCE(avg_bounce_rate, 0.0)", "NULL", "NULL"),
]


@register("n16_web_quick_insights", f"WITH sm AS ({_q('a09_web_summary')})\n" + rules_sql("sm", _N16_RULES, "web"))
def n16(t):
    return I.web_quick_insights(A.web_summary(ad.web_sessions_raw(t), _WCUR, _WPREV))


_BOTH = f"{T('sessions_change')} AND {T('engagement_rate_change')}"
_N17_RULES = [
    ("intent_problem", "'warning'", f"{_BOTH} AND sessions_change > 10 AND engagement_rate_change < -5",
     "'Sessions up, engagement down: intent problem'", "sessions", "sessions_change", "engagement_rate_change", "NULL"),
    ("regression", "'error'", f"{_BOTH} AND sessions_change < -10 AND engagement_rate_change < -5",
     "'Sessions and engagement down: UX or content regression'", "sessions", "sessions_change", "engagement_rate_change", "NULL"),
    ("healthy_growth", "'success'", f"{_BOTH} AND sessions_change > 10 AND engagement_rate_change > 5",
     "'Healthy growth'", "sessions", "sessions_change", "engagement_rate_change", "NULL"),
    ("quality_over_quantity", "'info'", f"{_BOTH} AND sessions_change < 0 AND engagement_rate_change > 0",
     "'Fewer visits, more engaged'", "sessions", "sessions_change", "engagement_rate_change", "NULL"),
]


def _w06_frame(t):
    d = A.web_daily_trend(ad.web_daily(t)).withColumnRenamed("engagement_pct", "engagement_rate")
    return d.select("date_day", "sessions", "engagement_rate")


@register("n17_trend_diagnosis", f"WITH sp AS ({_q('w06_half_split')})\n" + rules_sql("sp", _N17_RULES, "web_trend", 1))
def n17(t):
    return I.trend_diagnosis(W.half_split(_w06_frame(t), ["sessions", "engagement_rate"]))


@register("n17_trend_diagnosis_daily_window", f"""
WITH d AS (SELECT date_day, SUM(sessions) AS sessions, (1.0 - AVG(bounce_rate)) * 100 AS engagement_rate
  FROM web_daily WHERE date_day >= DATE '2024-01-11' GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date_day) AS rn, COUNT(*) OVER () AS n FROM d),
g AS (SELECT AVG(CASE WHEN rn <= n // 2 THEN sessions END) AS fs, AVG(CASE WHEN rn > n // 2 THEN sessions END) AS ss,
  AVG(CASE WHEN rn <= n // 2 THEN engagement_rate END) AS fe, AVG(CASE WHEN rn > n // 2 THEN engagement_rate END) AS se FROM r),
sp AS (SELECT CASE WHEN fs <> 0 THEN (ss - fs) / abs(fs) * 100 END AS sessions_change,
  CASE WHEN fe <> 0 THEN (se - fe) / abs(fe) * 100 END AS engagement_rate_change FROM g)
""" + rules_sql("sp", _N17_RULES, "web_trend", 1), ["web_daily"])
def n17w(t):
    d = _w06_frame(t).where(F.col("date_day") >= F.lit("2024-01-11").cast("date"))
    return I.trend_diagnosis(W.half_split(d, ["sessions", "engagement_rate"]))


# ------------------------------------------------------------------------- N18
_WC, _WP = _between("date_day", _WCUR), _between("date_day", _WPREV)
_N18_SQL = f"""
s AS (SELECT CAST(strptime(date, '%Y%m%d') AS DATE) AS date_day, * FROM web_sessions_raw),
tot AS (SELECT COALESCE(SUM(CASE WHEN {_WC} THEN CAST(sessions AS BIGINT) END), 0) AS cur_s,
  COALESCE(SUM(CASE WHEN {_WP} THEN CAST(sessions AS BIGINT) END), 0) AS prev_s,
  COALESCE(AVG(CASE WHEN {_WC} THEN CAST(bounceRate AS DOUBLE) END), 0.0) AS cur_b,
  COALESCE(AVG(CASE WHEN {_WP} THEN CAST(bounceRate AS DOUBLE) END), 0.0) AS prev_b
  FROM s WHERE date_day BETWEEN DATE '{_WPREV[0]}' AND DATE '{_WCUR[1]}'),
tc AS (SELECT *, CASE WHEN prev_s <> 0 THEN (cur_s - prev_s) / abs(prev_s) * 100 END AS sc,
  CASE WHEN prev_b <> 0 THEN (cur_b - prev_b) / abs(prev_b) * 100 END AS bc FROM tot),
head AS (
  SELECT 1 AS grp, 1 AS ord, CASE WHEN sc > 0 THEN 'Sessions up' ELSE 'Sessions down' END AS title, 'sessions' AS metric,
    CAST(cur_s AS DOUBLE) AS value, sc AS change, CASE WHEN sc > 0 THEN 'success' ELSE 'warning' END AS severity
  FROM tc WHERE {T('sc')} AND abs(sc) > 10
  UNION ALL
  SELECT 2, 1, CASE WHEN bc > 0 THEN 'More visits end on the first page' ELSE 'Fewer visits end on the first page' END, 'bounce_rate',
    CAST(cur_b AS DOUBLE), bc, CASE WHEN bc > 0 THEN 'warning' ELSE 'success' END
  FROM tc WHERE {T('bc')} AND abs(bc) > 5),
cs AS (SELECT sessionSource || ' / ' || sessionMedium AS source_medium, SUM(sessions) AS sessions FROM web_traffic
  WHERE {_WC} AND sessionSource IS NOT NULL AND sessionMedium IS NOT NULL GROUP BY 1
  QUALIFY ROW_NUMBER() OVER (ORDER BY SUM(sessions) DESC, source_medium) <= 5),
csr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sessions DESC, source_medium) AS rk FROM cs),
ps AS (SELECT sessionSource || ' / ' || sessionMedium AS source_medium, SUM(sessions) AS prev FROM web_traffic
  WHERE {_WP} AND sessionSource IS NOT NULL AND sessionMedium IS NOT NULL GROUP BY 1
  QUALIFY ROW_NUMBER() OVER (ORDER BY SUM(sessions) DESC, source_medium) <= 5),
sj AS (SELECT csr.*, ps.prev, CASE WHEN ps.prev <> 0 THEN (sessions - ps.prev) / abs(ps.prev) * 100 END AS ch
  FROM csr JOIN ps ON csr.source_medium = ps.source_medium),
src AS (SELECT 3 AS grp, CAST(rk AS INTEGER) AS ord,
  source_medium || CASE WHEN ch > 0 THEN ' traffic up' ELSE ' traffic down' END AS title, 'sessions' AS metric,
  CAST(sessions AS DOUBLE) AS value, ch AS change, 'info' AS severity FROM sj WHERE {T('ch')} AND abs(ch) > 20),
dv AS (SELECT deviceCategory AS device, SUM(CASE WHEN {_WC} THEN sessions END) AS cur, SUM(CASE WHEN {_WP} THEN sessions END) AS prev
  FROM web_tech WHERE deviceCategory IS NOT NULL AND date_day BETWEEN DATE '{_WPREV[0]}' AND DATE '{_WCUR[1]}' GROUP BY 1),
dc AS (SELECT *, CASE WHEN prev <> 0 THEN (cur - prev) / abs(prev) * 100 END AS ch FROM dv WHERE cur IS NOT NULL AND prev IS NOT NULL),
dev AS (SELECT 4 AS grp, CAST(ROW_NUMBER() OVER (ORDER BY device) AS INTEGER) AS ord,
  upper(device[1]) || lower(device[2:]) || CASE WHEN ch > 0 THEN ' traffic up' ELSE ' traffic down' END AS title,
  'sessions' AS metric, CAST(cur AS DOUBLE) AS value, ch AS change, 'info' AS severity FROM dc WHERE {T('ch')} AND abs(ch) > 15),
allr AS (SELECT * FROM head UNION ALL SELECT * FROM src UNION ALL SELECT * FROM dev),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY grp, ord) AS INTEGER) AS rank FROM allr)"""


def _what_changed(t):
    return I.what_changed(ad.web_sessions_raw(t), ad.web_traffic(t), ad.web_tech(t), _WCUR, _WPREV)


@register("n18_what_changed", f"""WITH {_N18_SQL}
SELECT title, metric, {R('value')} AS value, {R('change')} AS change, severity, rank FROM ranked WHERE rank <= 6""",
          ["web_sessions_raw", "web_traffic", "web_tech"])
def n18(t):
    return _what_changed(t)


@register("n18_actions", f"""WITH {_N18_SQL},
a AS (SELECT DISTINCT CASE WHEN contains(lower(title), 'more visits end on the first page')
    THEN 'List the releases of this period and test the affected pages'
  WHEN contains(lower(title), 'traffic down') THEN 'Find out why ' || split_part(title, ' ', 1) || ' sends fewer visits'
  WHEN contains(lower(title), 'traffic up') THEN 'Repeat what worked for ' || split_part(title, ' ', 1) END AS action
  FROM ranked WHERE rank <= 6)
SELECT action FROM a WHERE action IS NOT NULL ORDER BY action LIMIT 5""", ["web_sessions_raw", "web_traffic", "web_tech"])
def n18a(t):
    return I.what_changed_actions(_what_changed(t))


# ------------------------------------------------------------------------- N19
_N19_FACTS = """
po AS (SELECT 1.0 - AVG(CASE WHEN sessionMedium IN ('cpc','ppc','paidsearch','paid') THEN bounceRate END) AS paid_engagement,
  1.0 - AVG(CASE WHEN sessionMedium IN ('organic','referral','direct','(none)') THEN bounceRate END) AS organic_engagement
  FROM web_traffic WHERE sessionMedium IS NOT NULL),
mob AS (SELECT COALESCE(SUM(CASE WHEN lower(deviceCategory) = 'mobile' THEN sessions END), 0) * 100.0 / NULLIF(SUM(sessions), 0)
  AS mobile_pct FROM web_tech WHERE deviceCategory IS NOT NULL),
cg AS (SELECT country, SUM(sessions) AS s FROM web_geo WHERE country IS NOT NULL AND country <> '(not set)' GROUP BY 1),
con AS (SELECT MAX(s) * 100.0 / NULLIF(SUM(s), 0) AS concentration FROM cg),
nu AS (SELECT COALESCE(SUM(new_users) * 100.0 / NULLIF(SUM(users), 0), 0.0) AS new_pct FROM web_daily),
sh AS (SELECT COALESCE(COUNT(CASE WHEN averageSessionDuration < 10 THEN 1 END) * 100.0 / NULLIF(COUNT(*), 0), 0.0)
  AS short_pct FROM web_pages WHERE averageSessionDuration IS NOT NULL),
facts AS (SELECT * FROM po, mob, con, nu, sh)"""

_N19_RULES = [
    ("paid_lags_organic", "'warning'", "paid_engagement < organic_engagement - 0.1", "'Paid engagement lags organic'",
     "engagement_rate", "paid_engagement", "paid_engagement - organic_engagement", "NULL"),
    ("paid_beats_organic", "'success'", "paid_engagement > organic_engagement + 0.1", "'Paid engagement beats organic'",
     "engagement_rate", "paid_engagement", "paid_engagement - organic_engagement", "NULL"),
    ("mobile_heavy", "'info'", "mobile_pct > 60", "'Phones bring most visits'", "mobile_pct", "mobile_pct", "NULL", "NULL"),
    ("desktop_heavy", "'info'", "mobile_pct < 20", "'Most visits come from desktops'", "mobile_pct", "mobile_pct", "NULL", "NULL"),
    ("mobile_majority", "'warning'", "mobile_pct > 50", "'Phones bring most visits'", "mobile_pct", "mobile_pct", "NULL", "NULL"),
    ("country_concentration", "'info'", "concentration > 80", "'Traffic highly concentrated'", "concentration",
     "concentration", "NULL", "NULL"),
    ("high_new_users", "'warning'", "new_pct > 80", "'High new user share'", "new_pct", "new_pct", "NULL", "NULL"),
    ("strong_retention", "'success'", "new_pct < 30", "'Strong retention'", "new_pct", "new_pct", "NULL", "NULL"),
    ("short_sessions", "'warning'", "short_pct > 50", "'Most sessions under 10 seconds'", "short_pct", "short_pct", "NULL", "NULL"),
    ("engaged_sessions", "'success'", "short_pct < 20", "'Few sessions under 10 seconds'", "short_pct", "short_pct", "NULL", "NULL"),
]


@register("n19_segment_insights", f"WITH {_N19_FACTS}\n" + rules_sql("facts", _N19_RULES, "segments"),
          ["web_traffic", "web_tech", "web_geo", "web_daily", "web_pages"])
def n19(t):
    f = I.segment_facts(ad.web_traffic(t), ad.web_tech(t), ad.web_geo(t), ad.web_daily(t), ad.web_pages(t))
    return I.segment_insights(f)


# ------------------------------------------------------------------- N20-N23
_N20_RULES = [
    ("gads_spend", "'critical'", "prev_cost > 0 AND abs(cost_change) >= 0.80",
     "CASE WHEN cost_change > 0 THEN 'Google Ads spend increased' ELSE 'Google Ads spend decreased' END", "cost", "cost",
     "cost_change", "'Look for campaigns that raised bids or daily limits'"),
    ("gads_conversions_drop", "'high'", "prev_conversions > 0 AND conversions_change <= -0.20", "'Search-ads conversions fell from the day before'",
     "conversions", "conversions", "conversions_change", "'Confirm that tags fire and landing pages load'"),
    ("gads_conversions_up", "'medium'", "prev_conversions > 0 AND conversions_change >= 0.20", "'Search-ads conversions rose from the day before'",
     "conversions", "conversions", "conversions_change", "NULL"),
]
_N21_RULES = [
    ("gsc_weekly", "CASE WHEN abs(week_change) >= 0.50 THEN 'high' ELSE 'medium' END", "last_week > 0 AND abs(week_change) >= 0.20",
     "CASE WHEN week_change > 0 THEN 'Organic search clicks up week-over-week' ELSE 'Organic search clicks down week-over-week' END",
     "clicks", "this_week", "week_change", "NULL"),
]
_N22_FACTS = f"""
md AS (SELECT date_day, SUM(spend) AS spend, SUM(COALESCE(app_installs, 0)) AS installs FROM ads_lean
  WHERE platform = 'meta_ads' AND date_day >= DATE '{LI_ASOF}' - INTERVAL 7 DAY GROUP BY 1),
ml AS (SELECT *, LAG(spend) OVER (ORDER BY date_day) AS prev_spend, LAG(installs) OVER (ORDER BY date_day) AS prev_installs,
  ROW_NUMBER() OVER (ORDER BY date_day DESC) AS rd, COUNT(*) OVER () AS n FROM md),
mf AS (SELECT *, spend / installs AS lc, prev_spend / prev_installs AS pc FROM ml
  WHERE rd = 1 AND n >= 2 AND installs > 0 AND prev_installs > 0)"""
_N22_RULES = [
    ("meta_cpi", "'high'", "(lc - pc) / pc >= 0.20", "'Each social-ads install costs more'", "cpi", "lc", "(lc - pc) / pc",
     "'Sort ads by cost per result and pause the worst'"),
]


def _w04_meta(t):
    from mkpulse.operators.insights import insight_inputs  # noqa: F401

    cutoff = F.lit("2001-10-24").cast("date")
    d = ad.ads(t, dims=False).where((F.col("platform") == "meta_ads") & (F.col("date_day") >= cutoff))
    d = d.groupBy("date_day").agg(F.sum("spend").alias("spend"), F.sum(F.coalesce("app_installs", F.lit(0))).alias("installs"))
    return W.last_vs_previous(d, ["spend", "installs"])


def _n20(t):
    from mkpulse.plans.q_analytics import _google

    d = I.insight_inputs(_google(t, dims=False), LI_ASOF, 7).select("date_day", "cost", "conversions")
    return I.search_ads_daily_insights(W.last_vs_previous(d, ["cost", "conversions"]))


def _n21(t):
    d = ad.organic(t).where(F.col("date_day") >= F.lit("2001-07-25").cast("date")).groupBy("date_day").agg(
        F.sum("clicks").alias("clicks"))
    return I.organic_weekly_insights(W.first_last_window(d, "clicks"))


def _n22(t):
    return I.social_daily_insights(_w04_meta(t))


@register("n20_gads_daily_insights", f"WITH lv AS ({_q('w04_last_vs_previous')})\n" + rules_sql("lv", _N20_RULES, "gads"))
def n20(t):
    return _n20(t)


@register("n21_gsc_weekly_insights", f"WITH wk AS ({_q('w05_first_last_week')})\n" + rules_sql("wk", _N21_RULES, "gsc"))
def n21(t):
    return _n21(t)


@register("n22_meta_daily_insights", f"WITH {_N22_FACTS}\n" + rules_sql("mf", _N22_RULES, "meta"), ["ads_lean"])
def n22(t):
    return _n22(t)


@register("n23_daily_feed", f"""
WITH a AS ({_q('n20_gads_daily_insights')}), b AS ({_q('n21_gsc_weekly_insights')}),
c AS ({_q('n22_meta_daily_insights')}),
u AS (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c),
p AS (SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
  WHEN 'info' THEN 4 ELSE 5 END AS priority_rank FROM u)
SELECT source, rule_order, rule, priority, title, metric, value, change, action, priority_rank,
  CAST(ROW_NUMBER() OVER (ORDER BY priority_rank, src, rule_order) AS INTEGER) AS position FROM p""")
def n23(t):
    return I.merge_insights([_n20(t), _n21(t), _n22(t)])


# ------------------------------------------------------------------------- N24
_N24_RULES = [
    ("low_ctr", "'warning'", f"{T('spend')} AND COALESCE(ctr, 0.0) < 0.5", "'Low CTR Alert'", "ctr", "COALESCE(ctr, 0.0)", "NULL", "NULL"),
    ("strong_ctr", "'success'", f"{T('spend')} AND COALESCE(ctr, 0.0) > 1.5", "'Strong CTR'", "ctr", "COALESCE(ctr, 0.0)", "NULL", "NULL"),
    ("high_frequency", "'warning'", f"{T('spend')} AND COALESCE(frequency, 0.0) > 3", "'People see the ads too often'", "frequency",
     "COALESCE(frequency, 0.0)", "NULL", "NULL"),
    ("cpi_high", "'warning'", f"{T('spend')} AND COALESCE(app_installs, 0) > 0 AND COALESCE(cpi, 0.0) > 5",
     "'Each install costs too much'", "cpi", "COALESCE(cpi, 0.0)", "NULL", "NULL"),
    ("cpi_efficient", "'success'", f"{T('spend')} AND COALESCE(app_installs, 0) > 0 AND COALESCE(cpi, 0.0) < 2",
     "'Efficient CPI'", "cpi", "COALESCE(cpi, 0.0)", "NULL", "NULL"),
    ("budget_efficiency", "'info'",
     f"{T('spend')} AND COALESCE(spend, 0.0) > 0 AND COALESCE(clicks, 0) > 0 AND COALESCE(clicks, 0) / COALESCE(spend, 0.0) < 0.5",
     "'Budget Efficiency'", "clicks_per_spend", "COALESCE(clicks, 0) / COALESCE(spend, 0.0)", "NULL", "NULL"),
]


@register("n24_social_strategic", f"WITH k AS ({_q('a31_social_kpis')})\n" + rules_sql("k", _N24_RULES, "social"))
def n24(t):
    return I.social_strategic_insights(A.social_kpis(ad.ads(t, dims=False).where(F.col("platform") == "meta_ads")))


# ------------------------------------------------------------------------- N25
@register("n25_freshness", f"""
WITH l AS (
  SELECT 'web' AS source, MAX(CAST(strptime(date, '%Y%m%d') AS DATE)) AS last_date FROM web_sessions_raw
  UNION ALL SELECT 'organic', MAX(date_day) FROM organic_daily
  UNION ALL SELECT 'search_ads', MAX(CASE WHEN platform = 'google_ads' THEN date_day END) FROM ads_lean
  UNION ALL SELECT 'social_ads', MAX(CASE WHEN platform = 'meta_ads' THEN date_day END) FROM ads_lean)
SELECT source, {DS('last_date')} AS last_date, CAST(DATE '{EV_ASOF}' - last_date AS INTEGER) AS days_ago,
  CASE WHEN last_date IS NULL THEN 'no_data' WHEN DATE '{EV_ASOF}' - last_date <= 2 THEN 'ok'
    WHEN DATE '{EV_ASOF}' - last_date <= 5 THEN 'warning' ELSE 'error' END AS status
FROM l""", ["web_sessions_raw", "organic_daily", "ads_lean"])
def n25(t):
    paid = ad.ads(t, dims=False)
    frames = [
        I.last_date(ad.web_sessions_raw(t), "web", "date"),
        I.last_date(ad.organic_daily(t), "organic", "date_day"),
        I.last_date(paid.withColumn("d", F.when(F.col("platform") == "google_ads", F.col("date_day"))), "search_ads", "d"),
        I.last_date(paid.withColumn("d", F.when(F.col("platform") == "meta_ads", F.col("date_day"))), "social_ads", "d"),
    ]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return I.freshness(u, EV_ASOF)
