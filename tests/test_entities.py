"""The by=[...] re-aim: running an operator for many entities at once gives,
for each entity, what the single-entity run gives on that entity's rows."""

import datetime as dt

from pyspark.sql import functions as F

from mkpulse.operators import aggregates as A
from mkpulse.operators import insights as I
from mkpulse.operators import scoring as N
from mkpulse.operators import windows as W


def _paid(spark):
    rows = []
    for acct in ("a", "b"):
        for d in range(1, 21):
            for plat in ("google_ads", "meta_ads"):
                spend = float(d * (2 if acct == "a" else 3) + (5 if plat == "meta_ads" else 0))
                rows.append((acct, dt.date(2024, 1, d), plat, f"c{d % 4}", spend, d % 7, 100 + d, float(d % 3), None))
    return spark.createDataFrame(rows, "acct string, date_day date, platform string, campaign_name string, spend double, "
                                       "clicks long, impressions long, conversions double, app_installs long")


def _same(a, b, cols):
    key = lambda r: tuple(str(r[c]) for c in cols)
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_channel_breakdown_by_entity(spark):
    p = _paid(spark)
    multi = A.channel_breakdown(p, by=["acct"])
    for acct in ("a", "b"):
        single = A.channel_breakdown(p.where(F.col("acct") == acct))
        assert _same(multi.where(F.col("acct") == acct).drop("acct"), single, single.columns)


def test_rolling_and_quadrants_by_entity(spark):
    p = _paid(spark)
    daily = p.groupBy("acct", "date_day").agg(F.sum("spend").alias("v"))
    multi = W.rolling_anomalies(daily, "v", by=["acct"], threshold=1.0)
    camp = p.groupBy("acct", "campaign_name").agg(F.sum("spend").alias("spend"), F.sum("conversions").alias("conversions")).withColumn(
        "cpa", F.col("spend") / F.col("conversions"))
    mq = N.campaign_quadrants(camp, by=["acct"])
    for acct in ("a", "b"):
        d1 = daily.where(F.col("acct") == acct).drop("acct")
        assert _same(multi.where(F.col("acct") == acct).drop("acct"), W.rolling_anomalies(d1, "v", threshold=1.0),
                     ["date_day", "z_score", "anomaly_type"])
        c1 = camp.where(F.col("acct") == acct).drop("acct")
        assert _same(mq.where(F.col("acct") == acct), N.campaign_quadrants(c1), ["campaign_name", "quadrant", "median_spend"])


def test_exec_insights_by_entity(spark):
    p = _paid(spark)
    org = spark.createDataFrame([(a, dt.date(2024, 1, d), 10 * d) for a in ("a", "b") for d in range(1, 21)],
                                "acct string, date_day date, clicks long")
    cur, prev = ("2024-01-11", "2024-01-20"), ("2024-01-01", "2024-01-10")
    multi = I.exec_insights(I.exec_facts(p, org, cur, prev, by=["acct"]), by=["acct"])
    for acct in ("a", "b"):
        f1 = I.exec_facts(p.where(F.col("acct") == acct), org.where(F.col("acct") == acct), cur, prev)
        assert _same(multi.where(F.col("acct") == acct), I.exec_insights(f1), ["rule", "title", "value"])
