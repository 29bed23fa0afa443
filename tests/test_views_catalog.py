from pyspark.sql import functions as F

from mkpulse.plans import views as V
from mkpulse.sinks import load
from mkpulse.sources import catalog as C


def _bronze(spark):
    ga4 = spark.createDataFrame([("20240105", "10", "7", "2", "0.5"), ("2024-01-06", "x", "7", "2", "")],
                                "date string, sessions string, totalUsers string, newUsers string, bounceRate string")
    gads = spark.createDataFrame([("2024-01-05", 1, "c", 100, 5, 1500000, 1.5, 1.0, 10.0)],
                                 "date string, campaign_id long, campaign_name string, impressions long, clicks long, "
                                 "cost_micros long, cost double, conversions double, conversions_value double")
    return {"ga4_sessions": ga4, "gads_campaigns": gads}


def test_build_views_reports_missing_inputs(spark):
    views, report = V.build_views(_bronze(spark))
    status = {n: s for n, s, _ in report}
    assert status["ga4_sessions_v"] == "created" and status["gads_campaigns_v"] == "created"
    assert status["fact_paid_daily"] == "skipped"  # social insights never landed
    w = views["fact_web_daily"].orderBy("date_day").collect()
    assert [r.sessions for r in w] == [10, None] and w[1].bounce_rate is None


def test_register_and_drop(spark):
    rep = V.register_views(spark, _bronze(spark))
    assert rep.where(F.col("status") == "created").count() >= 3
    assert "fact_web_daily" in C.list_tables(spark, "fact_*")
    assert C.table_exists(spark, "fact_web_daily")
    assert {r.column_name for r in C.describe(spark, "fact_web_daily").collect()} == {"date_day", "sessions", "users", "new_users", "bounce_rate"}
    got = C.execute_query(spark, "SELECT SUM(sessions) AS s FROM fact_web_daily WHERE users >= :u", {"u": 7}).first().s
    assert got == 10
    assert V.drop_views(spark) >= 3 and not C.table_exists(spark, "fact_web_daily")


def test_catalog_counts_coverage_preview(spark):
    b = _bronze(spark)
    counts = {r.table: r.row_count for r in C.row_counts(b).collect()}
    assert counts == {"ga4_sessions": 2, "gads_campaigns": 1}
    cov = {r.source: r for r in C.coverage({"web": (b["ga4_sessions"], "date")}).collect()}
    assert str(cov["web"].min_date) == "2024-01-05" and str(cov["web"].max_date) == "2024-01-06"
    assert C.preview(b["ga4_sessions"], 1, "date").first().date == "20240105"


def test_load_modes(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert load(df, scratch + "/t", ["k"], lifetime=True)["mode"] == "replace"
    assert load(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), scratch + "/t", ["k"], lifetime=False)["mode"] == "upsert"
    assert sorted((r.k, r.v) for r in spark.read.parquet(scratch + "/t").collect()) == [(1, "b"), (2, "c")]
