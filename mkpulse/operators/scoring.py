"""Scores and classifications N01-N10, N13.

Set-level statistics (means, medians, percentiles) over open-ended sets
(keywords, campaigns) are a partially aggregated ``groupBy(by).agg`` attached
back with ``joins.with_stats`` - never a window over the whole set. Only the
sets the reference limits first (top-20 / top-25) use windows, partitioned by
entity and bounded by the limit. Medians of open-ended sets are exact and
distributed (``quantiles.with_medians``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.functions import div, nz, safe_divide
from mkpulse.operators.joins import attach_scalars, with_stats
from mkpulse.operators.quantiles import with_medians
from mkpulse.operators.topk import top_k
from mkpulse.session import materialize

By = Sequence[str]


def _w(by: By) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def _half_even(x: Column, digits: int = 0) -> Column:
    """Python-style round-half-even after dropping float noise (9 digits)."""
    return F.bround(F.round(x, 9), digits)


# ------------------------------------------------------------------------ N01
def traffic_quality(top: DataFrame, by: By = ()) -> DataFrame:
    """N01 over the top-20 source/medium set (A10 output)."""
    w = _w(by)
    df = (
        top.withColumn("engagement_rate", 1.0 - F.col("bounce_rate"))
        .withColumn("pages_per_session", div("page_views", "sessions"))
        .withColumn("quality_score", F.least(F.col("engagement_rate") * F.col("pages_per_session") * 20, F.lit(100.0)))
        .withColumn("_p75", F.percentile("sessions", 0.75).over(w))
    )
    q = F.col("quality_score")
    label = (
        F.when((F.col("sessions") > F.col("_p75")) & (q > 50), "Winner")
        .when(F.col("sessions") > F.col("_p75"), F.when(q > 30, "Monitor").otherwise("Junk"))
        .when(q > 60, "Scale")
        .otherwise("Standard")
    )
    return df.withColumn("insight", label).drop("_p75")


# ------------------------------------------------------------------------ N02
def campaign_efficiency(top: DataFrame, by: By = ()) -> DataFrame:
    """N02 over the top-20 campaign set (A25 output: conv_rate, avg_ctr as
    ``ctr`` of the reference, roas, cpa). Averages are unweighted with the
    reference's fallbacks; score rounded half-even and capped at 100."""
    w = _w(by)
    m_cr = F.avg("conv_rate").over(w)
    m_ctr = F.avg("avg_ctr").over(w)
    m_roas = F.avg("roas").over(w)
    m_cpa = F.avg(F.when(F.col("cpa") > 0, F.col("cpa"))).over(w)
    df = (
        top.withColumn("avg_conv_rate", F.when(m_cr > 0, m_cr).otherwise(0.01))
        .withColumn("avg_ctr_set", F.when(m_ctr > 0, m_ctr).otherwise(0.01))
        .withColumn("avg_roas", F.when(m_roas > 0, m_roas).otherwise(1.0))
        .withColumn("avg_cpa", F.coalesce(m_cpa, F.lit(1.0)))
    )
    two = F.lit(2.0)
    s = (
        F.least(F.col("conv_rate") / F.col("avg_conv_rate"), two) * 15
        + F.when(nz("avg_ctr") != 0, F.least(F.col("avg_ctr") / F.col("avg_ctr_set"), two) * 10).otherwise(0.0)
        + F.when(nz("roas") != 0, F.least(F.col("roas") / F.col("avg_roas"), two) * 15).otherwise(0.0)
        + F.when((F.col("cpa") > 0) & (F.col("avg_cpa") > 0), F.least(F.col("avg_cpa") / F.col("cpa"), two) * 10).otherwise(0.0)
    )
    df = df.withColumn("efficiency_score", F.least(_half_even(s), F.lit(100.0)).cast("bigint"))
    e = F.col("efficiency_score")
    grade = F.when(e >= 80, "A").when(e >= 60, "B").when(e >= 40, "C").when(e >= 20, "D").otherwise("F")
    return df.withColumn("grade", grade)


# ------------------------------------------------------------------------ N03
def campaign_quadrants(campaigns: DataFrame, by: By = ()) -> DataFrame:
    """Campaigns with conversions > 0 (and a CPA) split by the median
    spend and median CPA of that set. The campaign rows are materialized once;
    the medians are found over the whole cluster."""
    df = materialize(campaigns.where((F.col("conversions") > 0) & F.col("cpa").isNotNull()), "quadrants")
    df = with_medians(df, {"spend": "median_spend", "cpa": "median_cpa"}, by)
    hi = F.col("spend") >= F.col("median_spend")
    lo = F.col("cpa") <= F.col("median_cpa")
    q = F.when(hi & lo, "Stars").when(~hi & lo, "Question Marks").when(hi & ~lo, "Cash Cows").otherwise("Dogs")
    return df.withColumn("quadrant", q)


def quadrant_inputs(paid: DataFrame, by: By = ()) -> DataFrame:
    """N03 input: search-ads campaigns (conv = conversions) UNION ALL social
    campaigns (conv = installs + purchases), each HAVING spend > 0 - computed
    as ONE aggregate keyed by platform, so the paid fact is read once."""
    is_search = F.col("platform") == "google_ads"
    conv = F.when(is_search, F.col("conversions")).otherwise(nz("app_installs") + nz("purchases"))
    g = (
        paid.where(F.col("platform").isin("google_ads", "meta_ads"))
        .groupBy(*by, "platform", "campaign_name")
        .agg(
            F.sum("spend").alias("spend"),
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.sum(conv).cast("double").alias("conversions"),
        )
        .where(F.col("spend") > 0)
    )
    label = F.when(F.col("platform") == "google_ads", "Google Ads").otherwise("Meta Ads")
    return g.select(*by, label.alias("platform"), "campaign_name", "spend", "clicks", "impressions", "conversions",
                    F.when(F.col("conversions") > 0, F.col("spend") / F.col("conversions")).alias("cpa"))


# ------------------------------------------------------------------------ N04
def budget_optimizer(campaigns: DataFrame, by: By = ()) -> DataFrame:
    """N04 over campaign rows (cost > 0): efficiency ratio vs the mean, class,
    bounded %-change, recommended budget rescaled so its sum equals the spend.
    The campaign rows are materialized once for the two sets of statistics."""
    df = materialize(
        campaigns.where(F.col("cost") > 0)
        .withColumn("efficiency", div("conversions", "cost"))
        .withColumn("cpa", div("cost", "conversions")), "budgets")
    df = with_stats(df, [F.avg("efficiency").alias("_avg_eff")], by)
    r = F.when(F.col("_avg_eff") > 0, F.col("efficiency") / F.col("_avg_eff")).otherwise(1.0)
    df = df.withColumn("efficiency_ratio", r)
    x = F.col("efficiency_ratio")
    df = df.withColumn(
        "recommendation", F.when(x > 1.5, "Scale").when(x > 0.8, "Maintain").when(x > 0.5, "Reduce").otherwise("Pause")
    ).withColumn(
        "budget_change_pct", F.when(x > 1, F.least(F.lit(50.0), (x - 1) * 40)).otherwise(F.greatest(F.lit(-50.0), (x - 1) * 40))
    )
    df = df.withColumn("recommended_budget", F.col("cost") * (1 + F.col("budget_change_pct") / 100))
    df = with_stats(df, [F.sum("cost").alias("_tc"), F.sum("recommended_budget").alias("_tr")], by)
    df = df.withColumn("recommended_budget_normalized", F.col("recommended_budget") * F.col("_tc") / F.col("_tr")).withColumn(
        "budget_delta", F.col("recommended_budget_normalized") - F.col("cost"))
    return df.drop("_avg_eff", "_tc", "_tr")


# ------------------------------------------------------------------------ N05
def creative_fatigue(daily: DataFrame, by: By = (), min_days: int = 3, key: str = "campaign_id") -> DataFrame:
    """N05 over per (campaign, day) rows with ``frequency`` and ``ctr``:
    halves by date (W07), decline %, fatigue score, status. A campaign is its
    id: campaigns of one name stay apart; ``campaign_name``, if there, is the
    name of the last day. Fewer than ``min_days`` days tell no trend: such a
    campaign has the status ``Too few days`` and no decline or score."""
    keys = [*by, key]
    named = "campaign_name" in daily.columns and key != "campaign_name"
    o = Window.partitionBy(*keys).orderBy("date_day")
    df = daily.withColumn("_rn", F.row_number().over(o)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days_running"),
        F.avg("frequency").alias("avg_frequency"),
        F.sum("spend").alias("total_spend"),
        F.avg(F.when(first, F.col("ctr"))).alias("_c1"),
        F.avg(F.when(~first, F.col("ctr"))).alias("_c2"),
        *([F.max_by("campaign_name", "_rn").alias("campaign_name")] if named else []),
    )
    enough = F.col("days_running") >= min_days
    d = F.when(F.col("_c1") > 0, (F.col("_c1") - F.col("_c2")) / F.col("_c1") * 100).otherwise(0.0)
    g = g.withColumn("ctr_decline_pct", F.when(enough, d))
    score = F.when(enough,
        F.when(F.col("ctr_decline_pct") > 0, F.least(F.col("ctr_decline_pct") * 2, F.lit(40.0))).otherwise(0.0)
        + F.when(F.col("avg_frequency") > 2, F.least((F.col("avg_frequency") - 2) * 10, F.lit(30.0))).otherwise(0.0)
        + F.when(F.col("days_running") > 14, F.least((F.col("days_running") - 14) * 2.0, F.lit(30.0))).otherwise(0.0)
    )
    g = g.withColumn("fatigue_score", score)
    s = F.col("fatigue_score")
    status = F.when(~enough, "Too few days").when(s >= 60, "High Fatigue").when(s >= 30, "Moderate").otherwise("Healthy")
    return g.withColumn("status", status).drop("_c1", "_c2")


def fatigue_counts(fatigue: DataFrame, by: By = ()) -> DataFrame:
    """N05 summary: campaigns per status (one aggregate)."""
    return fatigue.groupBy(*by).agg(
        F.count(F.when(F.col("status") == "High Fatigue", 1)).alias("high"),
        F.count(F.when(F.col("status") == "Moderate", 1)).alias("moderate"),
        F.count(F.when(F.col("status") == "Healthy", 1)).alias("healthy"),
    )


# ------------------------------------------------------------------------ N06
def daypart_heatmap(hourly: DataFrame, by: By = ()) -> DataFrame:
    """Weekday (Mon=0) x hour sums with efficiency = conv / cost."""
    g = hourly.groupBy(*by, F.weekday("date_day").alias("day_num"), F.col("hour").cast("int").alias("hour")).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum("cost").alias("cost"),
        F.sum("impressions").alias("impressions"),
    )
    return g.withColumn("efficiency", div("conversions", "cost"))


def daypart_matrix(hourly: DataFrame, by: By = ()) -> DataFrame:
    """N06 pivot: weekday rows x 24 hour columns of conversions, 0-filled. The
    hour list is explicit (0..23), so no discovery job runs."""
    hours = list(range(24))
    p = hourly.groupBy(*by, F.weekday("date_day").alias("day_num")).pivot("hour", hours).agg(F.sum("conversions"))
    p = p.fillna(0.0, subset=[str(h) for h in hours])
    return p.select(*by, "day_num", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def best_worst_hours(hourly: DataFrame, k: int = 5, by: By = ()) -> DataFrame:
    """Per hour efficiency (rows with cost 0 dropped); best k and worst k
    (worst list keeps efficiency > 0 after taking k)."""
    g = hourly.groupBy(*by, F.col("hour").cast("int").alias("hour")).agg(
        F.sum("conversions").alias("conversions"), F.sum("cost").alias("cost"), F.sum("clicks").alias("clicks")
    )
    g = g.withColumn("efficiency", div("conversions", "cost")).where(F.col("efficiency").isNotNull())
    best = top_k(g, [F.desc("efficiency"), F.asc("hour")], k, by).withColumn("side", F.lit("best"))
    worst = top_k(g, [F.asc("efficiency"), F.asc("hour")], k, by).where(F.col("efficiency") > 0)
    return best.unionByName(worst.withColumn("side", F.lit("worst")))


# ------------------------------------------------------------------------ N07
#: Keywords that the clusters of an entity are fitted on at most: those with the most impressions.
FIT_ROWS = 500
#: Scaled features are whole numbers of 1 / GRID standard deviations, so that every engine finds the same clusters.
GRID = 10**6
#: Starts, and rounds of each.
STARTS, LLOYD_ROUNDS = 10, 20


@dataclass(frozen=True)
class KeywordFit:
    """Scaler, centres (whole numbers) and two principal components of one entity."""
    mean: list[float]
    std: list[float]
    centers: list[list[int]]
    components: list[list[float]]


def _whole(z: float) -> int:
    return int(math.copysign(math.floor(abs(z) * GRID + 0.5), z))


def fit_entity(names: Sequence[str], rows: Sequence[Sequence[float]], k: int, starts: int, rounds: int) -> KeywordFit | None:
    """Best of ``starts`` k-means fits over z-scaled features; None for fewer than 10 rows.

    Start s takes the ``k`` rows of least md5 of ``s:<name>`` as centres; each
    round assigns every row to the nearest centre (of equal ones the smaller
    number) and moves centres with rows to floor(sum / count). The start of
    least total distance wins, of equal ones the smaller number."""
    n, f = len(rows), len(rows[0]) if rows else 0
    if n < 10:
        return None
    mean = [math.fsum(r[j] for r in rows) / n for j in range(f)]
    std = [math.sqrt(math.fsum((r[j] - mean[j]) ** 2 for r in rows) / (n - 1)) for j in range(f)]
    x = np.array([[_whole((r[j] - mean[j]) / std[j]) if std[j] > 0 else 0 for j in range(f)] for r in rows], dtype=np.int64)
    best = None
    for s in range(starts):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"{s}:{names[i]}".encode()).hexdigest(), names[i]))
        c = x[order[:k]]
        for _ in range(rounds):
            at = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(len(c))])
        cost = int(((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
        if best is None or cost < best[0]:
            best = cost, c
    z = x / GRID
    _, v = np.linalg.eigh(z.T @ z)
    axes = v[:, ::-1].T[:2]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]  # the largest weight is positive
    return KeywordFit(mean, std, best[1].tolist(), [*axes.tolist(), *[[0.0] * f] * (2 - len(axes))])


@dataclass(frozen=True)
class KeywordClusters:
    """Fitted clusters, one fit for all keywords or one for each value of ``by``."""
    features: tuple[str, ...]
    fits: dict[str | None, KeywordFit]
    by: str | None = None

    def table(self, spark) -> DataFrame:
        """The fits as a small table: one row per entity."""
        kind = "_entity string, _mean array<double>, _std array<double>, _centers array<array<bigint>>, _components array<array<double>>"
        return spark.createDataFrame([(e, x.mean, x.std, x.centers, x.components) for e, x in self.fits.items()], kind)

    def assign(self, keywords: DataFrame) -> DataFrame:
        """Every keyword with its ``cluster`` and two principal components
        ``pca_x``, ``pca_y``; NULL where a feature is missing or nothing could
        be fitted. Column expressions over the table of fits, no Python."""
        fits = self.table(keywords.sparkSession)
        if self.by is not None:
            at = keywords.join(fits, F.col(self.by).cast("string").eqNullSafe(F.col("_entity")), "left")
        else:
            at = keywords.select("*", fits.select(F.struct("*")).scalar().alias("_m")).select(*keywords.columns, "_m.*")
        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        f = F.array(*[F.col(c).cast("double") for c in self.features])

        def scaled(x: Column, j: Column) -> Column:
            std = F.get("_std", j)
            return F.when(std > 0, F.round((x - F.get("_mean", j)) / std * GRID)).otherwise(0.0).cast("bigint")

        def total(a: Column, b: Column, each, zero: Column) -> Column:
            return F.aggregate(F.zip_with(a, b, each), zero, lambda s, x: s + x)

        def away(c: Column) -> Column:
            return total(c, F.col("_z"), lambda x, y: (x - y) * (x - y), F.lit(0).cast("bigint"))

        def along(axis: int) -> Column:
            return total(F.col("_z"), F.get("_components", F.lit(axis)), lambda x, y: x / GRID * y, F.lit(0.0))

        known = F.col("_z").isNotNull()
        at = at.withColumn("_z", F.when(whole & F.col("_centers").isNotNull(), F.transform(f, scaled)))
        at = at.withColumn("_far", F.when(known, F.transform("_centers", away)))
        near = (F.array_position("_far", F.array_min("_far")) - 1).cast("int")
        return at.select(*keywords.columns, near.alias("cluster"), F.when(known, along(0)).alias("pca_x"), F.when(known, along(1)).alias("pca_y"))


def fit_keyword_clusters(keywords: DataFrame, k: int = 5, n_init: int = STARTS, features: Sequence[str] = ("clicks", "impressions", "ctr", "position"),
                         fit_rows: int = FIT_ROWS, by: str | None = None, most: int = 100, rounds: int = LLOYD_ROUNDS) -> KeywordClusters:
    """K-means over z-scaled features and their first two principal
    components. Features that the frame lacks are left out (paid keywords have
    no position). Fitted on at most ``fit_rows`` keywords of an entity (most
    impressions, then by name), which is all that reaches the driver; any
    number is assigned. With ``by`` each value found in the data has a fit of
    its own; more than ``most`` values are refused. See :func:`fit_entity`."""
    feats = tuple(c for c in features if c in keywords.columns)
    whole = keywords.dropna(subset=list(feats))
    entity = F.col(by).cast("string") if by is not None else F.lit(None).cast("string")
    if by is not None and len(found := whole.select(entity).distinct().limit(most + 1).collect()) > most:
        raise ValueError(f"{by} has more than {most} values: {', '.join(sorted(str(r[0]) for r in found)[:5])}, ...")
    data = top_k(whole.select(entity.alias("_entity"), "keyword", *[F.col(c).cast("double") for c in feats]),
                 [F.desc("impressions"), F.asc("keyword")], fit_rows, ["_entity"] if by is not None else ())
    groups: dict[str | None, list] = {}
    for r in data.collect():
        groups.setdefault(r[0], []).append(r)
    fits = {e: fit_entity([r[1] for r in rows], [r[2:] for r in rows], k, n_init, rounds) for e, rows in groups.items()}
    return KeywordClusters(feats, {e: x for e, x in fits.items() if x is not None}, by)


def cluster_top_keywords(clustered: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` keywords with the most clicks of each cluster."""
    return top_k(clustered.where(F.col("cluster").isNotNull()), [F.desc("clicks"), F.asc("keyword")], n, ["cluster"])


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """N07 summary: keywords, Σclicks, Σimpressions, mean ctr per cluster."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("keywords"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("ctr").alias("avg_ctr"),
    )


# ------------------------------------------------------------------------ N09
def cannibalization(overlap: DataFrame) -> DataFrame:
    """Risk by organic position on J02 rows."""
    p = F.col("avg_position")
    return overlap.withColumn("risk", F.when(p <= 3, "High").when(p <= 5, "Medium").otherwise("Low"))


def cannibalization_summary(overlap: DataFrame, by: By = ()) -> DataFrame:
    """N09 summary: overlapping keywords, overlap spend, potential savings."""
    return overlap.groupBy(*by).agg(
        F.count(F.lit(1)).alias("overlapping_keywords"),
        nz(F.sum("paid_spend"), 0.0).alias("overlap_spend"),
        nz(F.sum(F.when(F.col("avg_position") <= 3, F.col("paid_spend"))), 0.0).alias("potential_savings"),
        F.count(F.when(F.col("avg_position") <= 3, 1)).alias("high_risk_keywords"),
    )


# ------------------------------------------------------------------------ N10
def wasted_spend(kw: DataFrame, k: int = 15, by: By = ()) -> DataFrame:
    """Keywords with spend and no conversions, top k by spend, with the
    entity's total wasted spend and count."""
    wasted = kw.where((F.col("cost") > 0) & ((F.col("conversions") == 0) | F.col("conversions").isNull()))
    wasted = with_stats(wasted, [F.sum("cost").alias("total_wasted"), F.count(F.lit(1)).alias("wasted_keywords")], by)
    return top_k(wasted, [F.desc("cost"), "keyword_text", "keyword_match_type", "campaign_name"], k, by)


def keyword_opportunities(kw: DataFrame, k: int = 15, by: By = ()) -> DataFrame:
    """Converting keywords with spend/conv <= Σspend/Σconv (over
    converting rows; the reference calls it 'median_cpa') and spend below the
    median positive spend; top k by conv_rate. The keyword rows are
    materialized once for the statistics and the rows."""
    kw = materialize(kw, "keywords")
    df = with_stats(kw, [
        (F.sum(F.when(F.col("conversions") > 0, F.col("cost"))) / F.nullif(F.sum("conversions"), F.lit(0))).alias("_cpa")], by)
    df = with_medians(df, {"cost": "_med"}, by, of=F.col("cost") > 0)
    df = df.where(
        (F.col("conversions") > 0) & (F.col("cost") / F.col("conversions") <= F.col("_cpa")) & (F.col("cost") < F.col("_med"))
    ).drop("_med", "_cpa")
    return top_k(df, [F.desc("conv_rate"), "keyword_text", "keyword_match_type", "campaign_name"], k, by)


# ------------------------------------------------------------------------ N13
def page_opportunity(top: DataFrame, k: int = 10, by: By = ()) -> DataFrame:
    """N13 over the top-25 landing pages: sessions x (mean engagement -
    engagement), positive only, top k."""
    df = top.withColumn("engagement_rate", 1.0 - F.col("bounce_rate"))  # (already there for A12 output)
    df = df.withColumn("opportunity_score", F.col("sessions") * (F.avg("engagement_rate").over(_w(by)) - F.col("engagement_rate")))
    return top_k(df.where(F.col("opportunity_score") > 0), [F.desc("opportunity_score"), "page_path", "page_title"], k, by)
