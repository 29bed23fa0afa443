from mkpulse.operators import insights as I


def _facts(spark, **kw):
    cols = dict(spend_cur=1200.0, spend_prev=1000.0, conversions_cur=100.0, conversions_prev=100.0, organic_cur=50,
                organic_prev=100, n_channels=2, top_channel="google_ads", top_spend=800.0, top_cpa=4.0)
    cols.update(kw)
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys()))
    from pyspark.sql import functions as F
    from mkpulse.functions import pct_change

    return (df.withColumn("spend_delta", pct_change("spend_cur", "spend_prev"))
            .withColumn("conversions_delta", pct_change("conversions_cur", "conversions_prev"))
            .withColumn("organic_delta", pct_change("organic_cur", "organic_prev"))
            .withColumn("cpa_cur", F.col("spend_cur") / F.col("conversions_cur"))
            .withColumn("cpa_prev", F.col("spend_prev") / F.col("conversions_prev"))
            .withColumn("cpa_delta", pct_change("cpa_cur", "cpa_prev")))


def test_exec_insights_order_and_limit(spark):
    r = I.exec_insights(_facts(spark)).orderBy("rule_order").collect()
    assert [x.rule for x in r] == ["spend_change", "organic_change", "cpa_change", "top_channel"]
    assert r[0].title == "Paid spend increased" and r[0].action == "No step needed, look again next period"
    assert r[-1].title == "Google Ads leads spend"
    r2 = I.exec_insights(_facts(spark, spend_cur=1500.0, conversions_cur=50.0)).collect()
    assert len(r2) == 4  # five rules fire, first four kept


def test_risk_signals(spark):
    r = {x.rule for x in I.risk_signals(_facts(spark, spend_cur=9500.0, conversions_cur=1000.0, conversions_prev=500.0)).collect()}
    assert r == {"spend_outgrows_conversions", "cpa_above_target", "budget_utilization", "conversion_target_met"}


def test_trend_diagnosis_first_match_only(spark):
    df = spark.createDataFrame([(20.0, -10.0), (-20.0, -10.0), (-5.0, 3.0), (0.0, 9.0)], "sessions_change double, engagement_rate_change double")
    r = [x.rule for x in I.trend_diagnosis(df).collect()]
    assert r == ["intent_problem", "regression", "quality_over_quantity"]


def test_daily_insights_and_merge(spark):
    d = spark.createDataFrame([(200.0, 100.0, 1.0, 0.5, 4.0, 5.0)],
                              "cost double, prev_cost double, cost_change double, conversions_change double, conversions double, prev_conversions double")
    g = I.search_ads_daily_insights(d)
    assert {x.priority for x in g.collect()} == {"critical", "medium"}
    w = spark.createDataFrame([(100, 40, 1.5)], "this_week long, last_week long, week_change double")
    o = I.organic_weekly_insights(w)
    assert o.first().priority == "high"
    m = I.merge_insights([o, g]).orderBy("position").collect()
    assert [x.priority for x in m] == ["critical", "high", "medium"]


def test_social_strategic(spark):
    k = spark.createDataFrame([(100.0, 0.2, 3.5, 6.0, 10, 20)], "spend double, ctr double, frequency double, cpi double, app_installs long, clicks long")
    assert [x.rule for x in I.social_strategic_insights(k).orderBy("rule_order").collect()] == [
        "low_ctr", "high_frequency", "cpi_high", "budget_efficiency"]


def test_what_changed_fires_and_actions(spark):
    import datetime as dt

    cur, prev = ("2024-01-08", "2024-01-14"), ("2024-01-01", "2024-01-07")
    sess = [((dt.date(2024, 1, d)).strftime("%Y%m%d"), str(100 if d <= 7 else 150), "0.2" if d <= 7 else "0.3") for d in range(1, 15)]
    raw = spark.createDataFrame(sess, "date string, sessions string, bounceRate string")
    traffic = spark.createDataFrame(
        [(dt.date(2024, 1, d), "google", "cpc", 50 if d <= 7 else 20) for d in range(1, 15)]
        + [(dt.date(2024, 1, d), "bing", "organic", 10 if d <= 7 else 30) for d in range(1, 15)],
        "date_day date, sessionSource string, sessionMedium string, sessions long")
    tech = spark.createDataFrame([(dt.date(2024, 1, d), "mobile", 10 if d <= 7 else 14) for d in range(1, 15)],
                                 "date_day date, deviceCategory string, sessions long")
    ch = I.what_changed(raw, traffic, tech, cur, prev).orderBy("rank").collect()
    # sources in current-period session order (bing 210 > google 140)
    assert [x.title for x in ch] == ["Sessions up", "More visits end on the first page", "bing / organic traffic up",
                                     "google / cpc traffic down", "Mobile traffic up"]
    acts = [x.action for x in I.what_changed_actions(I.what_changed(raw, traffic, tech, cur, prev)).collect()]
    assert acts == sorted(["List the releases of this period and test the affected pages", "Find out why google sends fewer visits",
                           "Repeat what worked for bing", "Repeat what worked for Mobile"])


def test_social_cpi_rule(spark):
    d = spark.createDataFrame([(120.0, 10, 100.0, 10)], "spend double, installs long, prev_spend double, prev_installs long")
    r = I.social_daily_insights(d).collect()
    assert len(r) == 1 and r[0].rule == "meta_cpi" and abs(r[0].change - 0.2) < 1e-12
    none = spark.createDataFrame([(120.0, 0, 100.0, 10)], d.schema)
    assert I.social_daily_insights(none).count() == 0


def test_organic_weekly_drop_medium(spark):
    w = spark.createDataFrame([(70, 100, -0.3)], "this_week long, last_week long, week_change double")
    r = I.organic_weekly_insights(w).first()
    assert r.priority == "medium" and r.title == "Organic search clicks down week-over-week"
