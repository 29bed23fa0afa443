import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mkpulse import sinks as K
from mkpulse.operators import grain_ledger as G
from mkpulse.operators import quality as Q
from mkpulse.plans import refresh as R
from mkpulse.plans import views as V

SCHEMA = "k long, j string, y int, v int"


def full(spark, path, keys):
    rep = Q.dq_report({"t": spark.read.parquet(path)}, {"t": keys}).first().asDict()
    groups = Q.grain_summary(spark.read.parquet(path), keys).first().duplicate_groups
    return rep | {"duplicate_groups": groups}


def test_grain_ledger_equals_the_full_check_after_every_upsert(spark, scratch):
    path, held, keys = os.path.join(scratch, "t"), os.path.join(scratch, "ledger"), ["k", "j"]

    def check(want_read):
        assert G.refresh_grain_ledger(spark, path, held, keys, "y") == want_read
        assert G.grain_report(spark, held, "t").first().asDict() == full(spark, path, keys)
        assert G.refresh_grain_ledger(spark, path, held, keys, "y") == []  # nothing changed since

    rows = [(i, "a" if i % 3 else None, 2020 + i % 3, i) for i in range(30)] + [(1, "a", 2020, 0), (1, "a", 2022, 0), (None, None, None, 1), (None, None, None, 2)]
    K.replace(spark.createDataFrame(rows, SCHEMA), path, ["y"])
    check(["y=2020", "y=2021", "y=2022", f"y={K.NULL_FOLDER}"])
    K.upsert(spark.createDataFrame([(2, "a", 2022, 9), (100, "b", 2022, 9)], SCHEMA), path, ["k", "j", "y"], partition_col="y")
    check(["y=2022"])
    K.upsert(spark.createDataFrame([(100, "b", 2030, 9), (100, "b", 2030, 9)], SCHEMA), path, ["k", "j"], partition_col="y")  # moves a key
    check(["y=2022", "y=2030"])
    K.replace_partitions(spark.createDataFrame([], SCHEMA), path, "y", ["y=2020", f"y={K.NULL_FOLDER}"])
    check([])  # partitions went; nothing to read
    keys = ["k"]
    check(["y=2021", "y=2022", "y=2030"])  # another key: all of it


def test_only_changed_partitions_are_read(spark, scratch):
    path, held = os.path.join(scratch, "t"), os.path.join(scratch, "ledger")
    K.replace(spark.createDataFrame([(i, "a", 2000 + i % 20, i) for i in range(100)], SCHEMA), path, ["y"])
    G.refresh_grain_ledger(spark, path, held, ["k"], "y")
    kept = {f: K.partition_stamps(spark, held)[f] for f in K.partition_stamps(spark, held)}
    K.upsert(spark.createDataFrame([(5, "z", 2005, 0)], SCHEMA), path, ["k", "y"], partition_col="y")
    assert G.refresh_grain_ledger(spark, path, held, ["k"], "y") == ["y=2005"]
    now = K.partition_stamps(spark, held)
    assert len(now) == 20 and sum(now[f] != kept[f] for f in now) == 1


def test_replace_partitions_refuses_rows_of_others(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, "a", 2020, 1)], SCHEMA), path, ["y"])
    with pytest.raises(ValueError, match="y=2021"):
        K.replace_partitions(spark.createDataFrame([(1, "a", 2021, 1)], SCHEMA), path, "y", ["y=2020"])
    assert spark.read.parquet(path).count() == 1


GADS = "date string, campaign_id long, campaign_name string, impressions long, clicks long, cost_micros long, cost double, conversions double, conversions_value double"
META = "date string, ad_account_id string, campaign_id string, campaign_name string, impressions long, reach long, clicks long, spend double, app_installs long, purchases long, purchase_value double"
GA4 = "date string, sessions string, totalUsers string, newUsers string, bounceRate string"


def test_one_changed_day_rewrites_one_day_of_each_fact(spark, scratch):
    gold = os.path.join(scratch, "gold")
    bronze = {n: os.path.join(scratch, n) for n in ("gads_campaigns", "meta_campaign_insights", "ga4_sessions")}
    days = [f"2024-01-{d:02d}" for d in range(1, 6)]

    def put(name, rows, schema, keys):
        K.load(spark.createDataFrame(rows, schema).withColumn("date_day", F.to_date("date")), bronze[name], [*keys, "date_day"], lifetime=False, partition_col="date_day")

    put("gads_campaigns", [(d, 1, "c", 100, 5, 10, 1.5, 1.0, 2.0) for d in days], GADS, ["campaign_id"])
    put("meta_campaign_insights", [(d, "acc", "9", "m", 50, 40, 3, 2.5, 1, 1, 9.0) for d in days[:3]], META, ["campaign_id"])
    put("ga4_sessions", [(d, "10", "7", "2", "0.5") for d in days], GA4, [])

    def whole():
        views, _ = V.build_views({n: spark.read.parquet(p) for n, p in bronze.items()})
        for fact in ("fact_paid_daily", "fact_web_daily"):
            got = spark.read.parquet(f"{gold}/{fact}").select(*views[fact].columns)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, views[fact].collect())) and got.count() > 0

    first = R.refresh_facts(spark, bronze, gold)
    assert first == {"fact_paid_daily": [f"date_day={d}" for d in days], "fact_web_daily": [f"date_day={d}" for d in days]}  # the others lack inputs
    whole()
    assert R.refresh_facts(spark, bronze, gold) == {"fact_paid_daily": [], "fact_web_daily": []}
    before = K.partition_stamps(spark, f"{gold}/fact_paid_daily")
    put("meta_campaign_insights", [(days[1], "acc", "9", "m", 50, 40, 3, 99.0, 1, 1, 9.0), ("2024-02-01", "acc", "9", "m", 1, 1, 1, 1.0, 1, 1, 1.0)], META, ["campaign_id"])
    assert R.refresh_facts(spark, bronze, gold) == {"fact_paid_daily": [f"date_day={days[1]}", "date_day=2024-02-01"], "fact_web_daily": []}
    after = K.partition_stamps(spark, f"{gold}/fact_paid_daily")
    assert [f for f in before if before[f] != after[f]] == [f"date_day={days[1]}"] and len(after) == 6
    whole()
    K.replace_partitions(spark.read.parquet(bronze["gads_campaigns"]).where("false"), bronze["gads_campaigns"], "date_day", [f"date_day={days[4]}"])
    assert R.refresh_facts(spark, bronze, gold)["fact_paid_daily"] == [f"date_day={days[4]}"]
    whole()
    assert spark.read.parquet(f"{gold}/fact_paid_daily").where(F.col("date_day") == dt.date(2024, 1, 5)).count() == 0


def test_bronze_of_a_view():
    assert R.bronze_of("fact_paid_daily") == ["gads_campaigns", "meta_campaign_insights"]
    assert R.bronze_of("dim_campaign") == ["gads_campaigns", "meta_campaign_insights"]
