import datetime as dt

import pytest

from pyspark.sql import functions as F

from mkpulse.operators import aggregates as A
from mkpulse.operators import joins as J
from mkpulse.operators import scoring as N
from mkpulse.operators import topk as T


def test_outer_gaps(spark):
    d = lambda x: dt.date(2024, 1, x)
    paid = spark.createDataFrame([(d(1), 10.0, 1.0, None)], "date_day date, spend double, conversions double, app_installs long")
    web = spark.createDataFrame([(d(2), 5)], "date_day date, sessions long")
    org = spark.createDataFrame([(d(3), 7)], "date_day date, clicks long")
    r = {x.date_day: x for x in J.daily_trend(paid, web, org).collect()}
    assert len(r) == 3 and r[d(1)].sessions == 0 and r[d(2)].paid_spend == 0.0 and r[d(3)].organic_clicks == 7


def test_others_bucket(spark):
    eight = spark.createDataFrame([(f"c{i}", 10 - i) for i in range(8)], "country string, sessions long")
    nine = spark.createDataFrame([(f"c{i}", 10 - i) for i in range(9)], "country string, sessions long")
    assert "Others" not in [r.country for r in T.top_n_others(eight, "country", "sessions").collect()]
    o = {r.country: r.sessions for r in T.top_n_others(nine, "country", "sessions").collect()}
    assert o["Others"] == 2 and len(o) == 9


def test_zero_divisors(spark):
    df = spark.createDataFrame([("c", 0, 0, 0.0, 0.0, 0.0)],
                               "campaign_name string, impressions long, clicks long, spend double, conversions double, conversion_value double")
    r = A.campaign_performance(df.withColumn("campaign_type", F.lit("S"))).first()
    assert r.cpa is None and r.roas == 0.0 and r.cpc == 0.0 and r.conv_rate == 0.0
    b = N.budget_optimizer(spark.createDataFrame([("c", 0.0, 0.0)], "campaign_name string, cost double, conversions double"))
    assert b.count() == 0  # cost 0 rows are not scored


def test_quadrants_and_budget(spark):
    rows = [("a", 100.0, 10.0), ("b", 50.0, 10.0), ("c", 100.0, 2.0), ("d", 10.0, 0.5)]
    df = spark.createDataFrame(rows, "campaign_name string, spend double, conversions double").withColumn(
        "cpa", F.col("spend") / F.col("conversions"))
    q = {r.campaign_name: r.quadrant for r in N.campaign_quadrants(df).collect()}
    assert q == {"a": "Stars", "b": "Question Marks", "c": "Cash Cows", "d": "Dogs"}
    b = N.budget_optimizer(df.withColumnRenamed("spend", "cost")).collect()
    assert abs(sum(x.recommended_budget_normalized for x in b) - sum(x.cost for x in b)) < 1e-9
    assert all(-50 <= x.budget_change_pct <= 50 for x in b)


def test_channel_table_organic_row(spark):
    paid = spark.createDataFrame([("google_ads", 10.0, 5, 100, 0.0, None)],
                                 "platform string, spend double, clicks long, impressions long, conversions double, app_installs long")
    org = spark.createDataFrame([(3, 30, 0.1, 2.0)], "clicks long, impressions long, ctr double, position double")
    r = {x.channel: x for x in A.channel_table(paid, org).collect()}
    assert r["google_ads"].cpa is None and r["Organic Search"].clicks == 3 and r["Organic Search"].spend == 0.0


def test_by_entity_windows_partitioned(spark):
    df = spark.createDataFrame([("x", "s1", 10, 0.5, 20), ("y", "s1", 10, 0.5, 20)],
                               "acct string, source string, sessions long, bounce_rate double, page_views long")
    plan = N.traffic_quality(df, by=["acct"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_lookup_fallback(spark):
    facts = spark.createDataFrame([(2001, 5), (2099, 1)], "cid long, clicks long")
    dim = spark.createDataFrame([(2001, "Albania")], "criterion_id long, country_name string")
    fb = F.concat(F.lit("Unknown ("), F.col("cid").cast("string"), F.lit(")"))
    r = {x.cid: x.country_name for x in J.lookup(facts, dim, "cid", "criterion_id", "country_name", fb).collect()}
    assert r == {2001: "Albania", 2099: "Unknown (2099)"}


def test_efficiency_grades_span(spark):
    rows = [("strong", 0.10, 0.10, 5.0, 10.0), ("avg", 0.05, 0.05, 2.0, 20.0), ("weak", 0.0, 0.0, 0.0, None),
            ("mid", 0.04, 0.06, 1.5, 25.0)]
    df = spark.createDataFrame(rows, "campaign_name string, conv_rate double, avg_ctr double, roas double, cpa double")
    g = {r.campaign_name: (r.efficiency_score, r.grade) for r in N.campaign_efficiency(df).collect()}
    assert g["strong"][1] in ("A", "B") and g["weak"] == (0, "F") and g["strong"][0] > g["avg"][0] > g["weak"][0]


def test_fatigue_statuses(spark):
    rows = []
    for d in range(30):  # long-running, declining CTR, high frequency -> High Fatigue
        rows.append(("tired", dt.date(2024, 1, 1) + dt.timedelta(days=d), 10.0, 4.0, 2.0 if d < 15 else 1.0))
    for d in range(5):  # short and flat -> Healthy
        rows.append(("fresh", dt.date(2024, 1, 1) + dt.timedelta(days=d), 10.0, 1.0, 2.0))
    for d in range(20):  # 20 days, frequency 3, flat -> 12 + 10 = 22 -> Healthy; with a mild decline -> Moderate
        rows.append(("aging", dt.date(2024, 1, 1) + dt.timedelta(days=d), 10.0, 3.0, 2.0 if d < 10 else 1.8))
    df = spark.createDataFrame(rows, "campaign_id string, date_day date, spend double, frequency double, ctr double")
    s = {r.campaign_id: (r.fatigue_score, r.status) for r in N.creative_fatigue(df).collect()}
    assert s["tired"][1] == "High Fatigue" and s["fresh"] == (0.0, "Healthy") and s["aging"][1] == "Moderate"


def test_fatigue_keeps_campaigns_of_one_name_apart(spark):
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(1, "Brand", day(d), 1.0, 1.0, 4.0 - 0.3 * d) for d in range(12)] + [(2, "Brand", day(d), 1.0, 1.0, 1.0 + 0.3 * d) for d in range(12)]
    rows += [(3, "Brand", day(d), 1.0, 9.0, 1.0) for d in range(2)]
    df = spark.createDataFrame(rows, "campaign_id long, campaign_name string, date_day date, spend double, frequency double, ctr double")
    got = {r.campaign_id: r for r in N.creative_fatigue(df).collect()}
    assert got[1].ctr_decline_pct > 40 and got[2].ctr_decline_pct < -40 and {r.campaign_name for r in got.values()} == {"Brand"}
    assert got[3].status == "Too few days" and got[3].fatigue_score is None


def test_spend_pivot_has_every_campaign(spark):
    rows = [(dt.date(2024, 1, 1), f"c{i:02d}", float(i)) for i in range(15)] + [(dt.date(2024, 1, 2), "c01", 5.0), (dt.date(2024, 1, 2), None, 7.0)]
    df = spark.createDataFrame(rows, "date_day date, campaign_name string, spend double")
    p = A.spend_pivot(df)
    assert p.columns == ["date_day", "(none)", *[f"c{i:02d}" for i in range(15)]]
    assert {r.date_day: (r.c14, r["(none)"]) for r in p.collect()} == {dt.date(2024, 1, 1): (14.0, 0.0), dt.date(2024, 1, 2): (0.0, 7.0)}
    with pytest.raises(ValueError, match="long form"):
        A.pivot_values(df, "campaign_name", most=5)
    assert A.spend_by_campaign(df).count() == 17


def test_age_gender_matrix_has_every_gender(spark):
    df = spark.createDataFrame([("18-24", "male", 1.0), ("18-24", "nonbinary", 5.0), ("25-34", None, 2.0)], "age string, gender string, spend double")
    got = {r.age: r.asDict() for r in A.age_gender_matrix(df).collect()}
    assert got["18-24"]["nonbinary"] == 5.0 and got["25-34"]["unknown"] == 2.0


@pytest.mark.parametrize("n", [1, 2, 9, 10, 501])
def test_medians_are_exact(spark, n):
    import random
    import statistics

    from mkpulse.operators.quantiles import medians

    rng = random.Random(n)
    rows = [(g, rng.choice([0.0, -3.5, rng.lognormvariate(0, 3), 7.25, 1e12 * rng.random(), 1e-9 * rng.random()])) for g in "ab" for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").cache()
    got = {r.g: r.m for r in medians(df, {"v": "m"}, ["g"]).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(statistics.median([v for k, v in rows if k == g and v is not None]), abs=0, rel=1e-15)
    whole = medians(df, {"v": "m"})
    assert whole.first().m == pytest.approx(statistics.median([v for _, v in rows if v is not None]), abs=0, rel=1e-15)
    assert medians(df.limit(0), {"v": "m"}).first().m is None
    assert "percentile(" not in whole._jdf.queryExecution().executedPlan().toString()  # that one holds all values


def test_medians_of_many_values_and_columns_in_two_reads(spark, scratch):
    """More values than the summary keeps, heavy ties around the middle, two columns at once."""
    import statistics

    from mkpulse.operators.quantiles import medians, with_medians

    df = spark.range(120_000).select(F.nullif(F.col("id") % 2, F.lit(1)).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(99991)) / 7).alias("a"),
                                     F.when(F.col("id") % 11 > 0, -F.pmod(F.hash("id", F.lit(1)), F.lit(10**6)).cast("double")).alias("b"))
    df.write.parquet(scratch + "/v")
    df = spark.read.parquet(scratch + "/v")
    rows = df.collect()
    got = medians(df, {"a": "ma", "b": "mb"}, ["g"])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    found = got.collect()
    assert {r.g for r in found} == {0, None}
    for r in found:
        assert r.ma == statistics.median([x.a for x in rows if x.g == r.g])
        assert r.mb == statistics.median([x.b for x in rows if x.g == r.g and x.b is not None])
    whole = medians(df, {"a": "ma", "b": "mb"})
    assert whole.collect() == [(statistics.median([x.a for x in rows]), statistics.median([x.b for x in rows if x.b is not None]))]
    both = with_medians(df, {"a": "ma", "b": "mb"}, of=F.col("a") > 5)
    assert both.select("ma", "mb").distinct().collect() == [
        (statistics.median([x.a for x in rows if x.a > 5]), statistics.median([x.b for x in rows if x.a > 5 and x.b is not None]))]


def test_per_entity_top_k_prelimits_before_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("acct"), F.col("id").alias("v"))
    top = T.top_k(df, [F.desc("v")], 5, by=["acct"])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # partial limit per task, before the exchange
    got = sorted((r.acct, r.v) for r in top.collect())
    assert len(got) == 15 and got[:5] == [(0, 4986), (0, 4989), (0, 4992), (0, 4995), (0, 4998)]


def test_spread_rank_numbers_large_entities_in_many_tasks(spark):
    from mkpulse.operators.topk import rank_within, spread_rank

    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 10)).alias("e"),
                                  (F.col("id") * 7919 % 1000).alias("v"), "id")
    got = spread_rank(df, [F.desc("v"), F.asc("id")], ["e"], "r")
    want = rank_within(df, [F.desc("v"), F.asc("id")], ["e"], "r")
    assert got.exceptAll(want).isEmpty() and got.count() == 5000
