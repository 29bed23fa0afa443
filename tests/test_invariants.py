"""Invariants from the survey's test strategy, on the sf0.001 driver tables."""

from pyspark.sql import functions as F

from mkpulse.operators import aggregates as A
from mkpulse.operators import joins as J
from mkpulse.operators import quality as Q
from mkpulse.operators import windows as W
from mkpulse.plans import adapters as ad
from mkpulse.session import Tables
from mkpulse.sinks import dedupe

SF = "/root/testdata/sf0.001"


def test_dedupe_leaves_grain_clean(spark):
    t = Tables(spark, SF)
    d = ad.dup_lines(t)
    keys = ["l_orderkey", "l_linenumber"]
    assert Q.grain_summary(d, keys).first().duplicate_rows > 0
    assert Q.grain_summary(dedupe(d, keys), keys).first().duplicate_rows == 0


def test_trend_totals_equal_source_totals(spark):
    t = Tables(spark, SF)
    paid, web, org = ad.ads(t, dims=False), ad.web_daily(t), ad.organic_daily(t)
    tr = J.daily_trend(paid, web, org).agg(F.sum("paid_spend").alias("s"), F.sum("sessions").alias("w"),
                                           F.sum("organic_clicks").alias("o")).first()
    assert abs(tr.s - paid.agg(F.sum("spend")).first()[0]) < 1e-6
    assert tr.w == web.agg(F.sum("sessions")).first()[0]
    assert tr.o == org.agg(F.sum("clicks")).first()[0]


def test_funnel_percentages_within_definition(spark):
    t = Tables(spark, SF)
    steps = A.funnel_steps_from_counts(A.funnel_counts(ad.web_daily(t), ad.web_pages(t)))
    for r in W.funnel_steps(steps).collect():
        if r.conversion_rate is not None:
            assert r.conversion_rate >= 0 and abs(r.conversion_rate + r.dropoff_rate - 100) < 1e-9 or r.conversion_rate == 0


def test_channel_totals_equal_paid_totals(spark):
    t = Tables(spark, SF)
    paid = ad.ads(t, dims=False)
    ch = A.channel_breakdown(paid).agg(F.sum("spend").alias("s"), F.sum("conversions").alias("c")).first()
    tot = A.paid_totals(paid).first()
    assert abs(ch.s - tot.spend) < 1e-6 and abs(ch.c - tot.conversions) < 1e-9
