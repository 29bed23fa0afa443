import datetime as dt

from mkpulse.operators import quality as Q


def _dups(spark):
    rows = [("2026-02-02", 0, dt.datetime(2026, 2, 3, h)) for h in range(11)] + [("2026-02-02", 0, None), ("2026-02-03", 1, None)]
    return spark.createDataFrame(rows, "date string, campaign_id long, extracted_at timestamp")


def test_grain_check(spark):
    df = _dups(spark)
    s = Q.grain_summary(df, ["date", "campaign_id"], "gads_daily_summary").first()
    assert s.duplicate_groups == 1 and s.duplicate_rows == 11
    samples = Q.grain_samples(df, ["date", "campaign_id"]).collect()
    assert len(samples) == 1 and samples[0].row_count == 12
    bad = Q.grain_summary(df, ["date", "nope"], "t").first()
    assert bad.duplicate_rows == -1 and "nope" in bad.error


def test_null_keys_and_profile(spark):
    df = _dups(spark)
    n = {r.column: r.null_count for r in Q.null_keys(df, ["date", "extracted_at"]).collect()}
    assert n == {"extracted_at": 2}
    p = Q.duplicate_profile(df, ["date", "campaign_id"]).first()
    assert (p.total_rows, p.unique_keys, p.duplicate_rows) == (13, 2, 11)


def test_null_inside_tuple_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    assert Q.duplicate_profile(df, ["a", "b"]).first().unique_keys == 2


def test_report_availability_time_series(spark):
    df = _dups(spark)
    r = Q.dq_report({"gads_daily_summary": df}, {"gads_daily_summary": ("date", "campaign_id")}).first()
    assert r.row_count == 13 and r.grain_ok is False and r.duplicate_rows == 11
    a = {x.table: (x.present, x.has_data) for x in Q.availability({"x": df, "e": df.limit(0), "m": None}).collect()}
    assert a == {"x": (True, True), "e": (True, False), "m": (False, False)}
    ts = Q.validate_time_series(spark.createDataFrame([("20240102", "3"), ("bad", "1"), ("2024-01-01", "2")], "d string, v string"), "d", ["v"])
    assert [r.v for r in ts.collect()] == [2.0, 3.0]


def test_check_grains_gate(spark):
    import pytest

    df = _dups(spark)
    with pytest.raises(Q.GrainViolation):
        Q.check_grains({"gads_daily_summary": df}, {"gads_daily_summary": ("date", "campaign_id")})
    ok = Q.check_grains({"t": df}, {"t": ("date", "campaign_id", "extracted_at")})
    assert ok.first().duplicate_rows == 0
