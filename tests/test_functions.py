import datetime as dt

from pyspark.sql import functions as F

from mkpulse import functions as FN
from mkpulse.functions import periods as P


def test_safe_int_and_float(spark):
    df = spark.createDataFrame([("12.7",), ("-3.9",), ("x",), (None,), ("NaN",), ("",)], "s string")
    out = df.select(FN.safe_int("s").alias("i"), FN.safe_float("s").alias("f"), FN.safe_float("s", None).alias("g")).collect()
    assert [r.i for r in out] == [12, -3, 0, 0, 0, 0]
    assert [r.f for r in out] == [12.7, -3.9, 0.0, 0.0, 0.0, 0.0]
    assert out[2].g is None and out[4].g is None


def test_safe_divide_and_pct_change(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 5.0), (None, 5.0), (6.0, -3.0)], "a double, b double")
    r = df.select(FN.safe_divide("a", "b").alias("d"), FN.pct_change("a", "b").alias("p"),
                  FN.pct_change_abs("a", "b").alias("q")).collect()
    assert [x.d for x in r] == [0.0, 2.0, 0.0, -2.0]
    assert r[0].p is None and r[1].p == 100.0 and r[3].p is None
    assert r[3].q == 300.0 and r[0].q is None and r[2].q is None


def test_two_date_formats(spark):
    df = spark.createDataFrame([("20240105",), ("2024-01-05",), ("x",)], "s string")
    got = [r.d for r in df.select(FN.to_day("s").alias("d")).collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None]


def test_clean_and_flatten(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "`a-b` int, s struct<x:int, t:struct<y:int>>")
    assert FN.clean_columns(df).columns == ["a_b", "s"]
    flat = FN.flatten(df)
    assert flat.columns == ["a-b", "s_x", "s_t_y"] and flat.first()["s_t_y"] == 3


def test_truncate_humanize_concat(spark):
    long_path = "/" + "a" * 30 + "/" + "b" * 30
    df = spark.createDataFrame([(long_path, "SEARCH_ADS", "s", None)], "p string, t string, a string, b string")
    r = df.select(FN.truncate_tail("p").alias("tail"), FN.last_path_segment("p").alias("last"),
                  FN.humanize("t").alias("h"), FN.concat_key("a", "b").alias("k"), FN.concat_key("a", "t").alias("k2")).first()
    assert r.tail == "..." + long_path[-47:] and r.last == "b" * 30
    assert r.h == "Search Ads" and r.k is None and r.k2 == "s / SEARCH_ADS"


def test_action_count_priority(spark):
    schema = "actions array<struct<action_type:string,value:string>>"
    rows = [
        ([("app_install", "3"), ("mobile_app_install", "2.9")],),  # mobile first -> 2
        ([("mobile_app_install", "0"), ("app_install", "5")],),  # present with 0 wins -> 0
        (None,),
        ([],),
        ([("purchase", "1.5"), ("purchase", "7")],),  # first of the type
    ]
    df = spark.createDataFrame(rows, schema)
    r = df.select(FN.action_count("actions", FN.APP_INSTALL_TYPES).alias("i"), FN.action_count("actions", "purchase").alias("p"),
                  FN.action_value("actions", "purchase").alias("v")).collect()
    assert [x.i for x in r] == [2, 0, 0, 0, 0]
    assert [x.p for x in r] == [0, 0, 0, 0, 1] and r[4].v == 1.5


def test_cents_to_units(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("1050",)], "b string")
    assert [r.u for r in df.select(FN.cents_to_units("b").alias("u")).collect()] == [None, None, 0.0, 10.5]
    num = spark.createDataFrame([(0,), (250,)], "b long")
    assert [r.u for r in num.select(FN.cents_to_units("b", numeric=True).alias("u")).collect()] == [None, 2.5]


def test_periods():
    assert P.etl_range("2024-01-31", days=7) == (dt.date(2024, 1, 24), dt.date(2024, 1, 30))
    assert P.etl_range("2024-01-31", lifetime_start="2020-01-01") == (dt.date(2020, 1, 1), dt.date(2024, 1, 30))
    assert P.social_range("2024-01-31", 30) == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert P.preset_range("2024-01-31", 7) == (dt.date(2024, 1, 24), dt.date(2024, 1, 31))
    assert P.preset_range(None, start="2024-02-01", end="2024-01-01") == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert P.comparison_range("2024-01-24", "2024-01-31") == (dt.date(2024, 1, 16), dt.date(2024, 1, 23))
    assert P.comparison_range("2024-01-24", "2024-01-31", "wow") == (dt.date(2024, 1, 17), dt.date(2024, 1, 24))
    assert P.comparison_range("2024-01-24", "2024-01-31", "none") is None


def test_tag_periods_overlap(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), 1.0) for d in range(1, 15)], "date_day date, v double")
    t = P.tag_periods(df, "date_day", ("2024-01-08", "2024-01-14"), ("2024-01-05", "2024-01-10"))
    counts = {r.period: r["count"] for r in t.groupBy("period").count().collect()}
    assert counts == {"current": 7, "previous": 6}  # days 8-10 are counted in both


def test_half_even_rounding(spark):
    from mkpulse.operators.scoring import _half_even

    df = spark.createDataFrame([(62.5,), (63.5,)], "s double")
    assert [r.x for r in df.select(_half_even(F.col("s")).alias("x")).collect()] == [62.0, 64.0]


def test_action_count_last_match(spark):
    df = spark.createDataFrame([([("app_install", "1"), ("purchase", "2"), ("app_install", "4")],), (None,)],
                               "actions array<struct<action_type:string,value:string>>")
    r = df.select(FN.action_count_last("actions", "app_install").alias("x")).collect()
    assert [x.x for x in r] == [4, 0]
