import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mkpulse.operators import windows as W


def _series(spark, values, start=dt.date(2024, 1, 1)):
    rows = [(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date_day date, v double")


def test_rolling_short_series(spark):
    assert W.rolling_anomalies(_series(spark, [1, 2, 3, 4, 5, 6]), "v").count() == 0
    r = W.rolling_anomalies(_series(spark, [1, 2, 3, 4, 5, 6, 7, 8]), "v").orderBy("date_day").collect()
    assert len(r) == 8
    assert r[0].z_score is None and r[1].z_score is None and r[2].z_score is not None
    assert all(x.anomaly_type == "normal" for x in r)


def test_rolling_spike_cannot_pass_default_threshold(spark):
    r = W.rolling_anomalies(_series(spark, [10, 10, 10, 10, 10, 10, 20]), "v").orderBy("date_day").collect()
    assert r[-1].z_score == pytest.approx(6 / math.sqrt(7), rel=1e-9)
    assert r[-1].anomaly_type == "normal"
    r2 = W.rolling_anomalies(_series(spark, [10, 10, 10, 10, 10, 10, 20]), "v", threshold=2.0).orderBy("date_day").collect()
    assert r2[-1].anomaly_type == "spike"


def test_flat_series(spark):
    r = W.rolling_anomalies(_series(spark, [5] * 8), "v").collect()
    assert all(x.z_score is None for x in r)
    m = W.minmax_normalize(_series(spark, [5] * 3), "v").collect()
    assert all(x.v_norm is None for x in m)


def test_week_overlap(spark):
    r = W.first_last_window(_series(spark, [1, 2, 3, 4, 5, 6, 7, 8]), "v").first()
    assert r.this_week == 35 and r.last_week == 28  # the two windows share 6 days
    assert W.first_last_window(_series(spark, [1] * 8), "v", disjoint=True).count() == 0


def test_odd_half(spark):
    r = W.half_split(_series(spark, [1, 2, 3, 4, 5]), ["v"]).first()
    assert r.first_v == 1.5 and r.second_v == 4.0


def test_forecast_decline_floored(spark):
    f = W.linear_forecast(_series(spark, list(range(140, 0, -10))), "v", horizon=14).orderBy("i").collect()
    assert len(f) == 14 and all(x.forecast >= 0 for x in f) and f[-1].forecast == 0.0
    assert f[0].direction == "down" and f[0].slope == pytest.approx(-10.0)


def test_funnel(spark):
    df = spark.createDataFrame([(1, "a", 100), (2, "b", 20), (3, "c", 0), (4, "d", 0)], "step int, name string, users long")
    r = W.funnel_steps(df).orderBy("step").collect()
    assert r[0].conversion_rate is None and r[1].conversion_rate == 20.0 and r[1].dropoff_rate == 80.0
    assert r[3].conversion_rate == 0.0 and r[3].dropoff_rate == 0.0
    b = W.biggest_dropoff(W.funnel_steps(df)).first()
    assert b.step_name == "c" and b.dropoff_rate == 100.0 and b.severity == "critical"


def test_keep_latest_nulls_last(spark):
    rows = [(1, dt.datetime(2026, 2, 2, h), h) for h in range(11)] + [(1, None, 99)]
    df = spark.createDataFrame(rows, "k int, extracted_at timestamp, v int")
    r = W.keep_latest(df, ["k"]).collect()
    assert len(r) == 1 and r[0].v == 10


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("size", [3, 10, 1000])
def test_halo_windows_equal_whole_ones(spark, by, size):
    """Ranges shorter and longer than the window, an entity that is NULL, values that are NULL."""
    import random

    rng = random.Random(size)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, 1.0, 2.5, float(rng.randint(0, 99))])) for t in rng.sample(range(9999), 200)]
    df = spark.createDataFrame(rows + [("few", 1, 1.0), ("few", 2, 2.0)], "g string, t int, v double")

    def same(a, b):
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))

    same(W.moving_average(df, "v", "t", 7, by, spread=size), W.moving_average(df, "v", "t", 7, by))
    for current in (True, False):
        how = {"date_col": "t", "by": by, "threshold": 1.2, "include_current": current}
        same(W.rolling_anomalies(df, "v", spread=size, **how), W.rolling_anomalies(df, "v", **how))


def test_halo_windows_need_no_single_task(spark):
    df = spark.range(20_000).select("id", (F.col("id") * 7 % 101).cast("double").alias("v"))
    out = W.moving_average(df, "v", "id", 7, spread=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "Window [avg" in plan.replace("Window [count", "Window [avg")
    per_range = W.with_halo(df, ["id"], 7, size=500).groupBy("_range").count()
    assert per_range.count() == 40 + 1 and per_range.agg({"count": "max"}).first()[0] == 506  # the last one holds a halo alone
    want = W.moving_average(df, "v", "id", 7)
    assert out.exceptAll(want).isEmpty() and out.count() == 20_000


def test_forecast_has_no_window_over_the_series(spark):
    out = W.linear_forecast(_series(spark, [5 + i % 3 for i in range(40)]), "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit 14" in plan and out.count() == 14
