"""Registered queries: streaming R01-R02, run to completion (availableNow)
over the driver tables as the landed stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse.plans.catalog import DS, R, register
from mkpulse.sinks import remove, replace
from mkpulse.streaming import landing_to_bronze, late_rows, run_folder, windowed_kpis

_LINE_KEYS = ["l_orderkey", "l_linenumber", "ship_year"]
_TIEBREAK = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate"]
_LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_shipdate"]


@register("r01_landing_to_bronze", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('l_quantity')} AS l_quantity, {R('l_extendedprice')} AS l_extendedprice,
  {R('l_discount')} AS l_discount, {R('l_tax')} AS l_tax, {DS('l_shipdate')} AS l_shipdate,
  CAST(year(l_shipdate) AS INTEGER) AS ship_year, CAST(NULL AS VARCHAR) AS extracted_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber, year(l_shipdate) ORDER BY l_quantity DESC,
  l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC, l_tax DESC, l_shipdate DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def r01(t):
    spark = t.spark
    src = t.root
    schema = t.lineitem.select(*_LINE_COLS).schema
    base = run_folder(spark, "r01")
    q = landing_to_bronze(spark, src, schema, base + "/bronze", _LINE_KEYS, base + "/_checkpoint",
                          glob="lineitem.parquet", tiebreak=_TIEBREAK, partition_col="ship_year",
                          derive=lambda b: b.withColumn("ship_year", F.year("l_shipdate")))
    q.awaitTermination()
    return spark.read.parquet(base + "/bronze")


@register("r02_hourly_kpis", f"""
SELECT {DS("date_trunc('hour', ts)")} AS window_start, {DS("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS window_end,
  event_type, COUNT(*) AS events, {R('SUM(value)')} AS value_sum
FROM events GROUP BY date_trunc('hour', ts), event_type""")
def r02h(t):
    spark = t.spark
    base = run_folder(spark, "r02h")
    q = windowed_kpis(spark, t.root, t.events.schema, base + "/kpis", base + "/_checkpoint", window="1 hour",
                      lateness="3 days", glob="events.parquet")
    q.awaitTermination()
    return spark.read.parquet(base + "/kpis").drop("window_day")


@register("r02_windowed_kpis", f"""
SELECT {DS("date_trunc('day', ts)")} AS window_start, {DS("date_trunc('day', ts) + INTERVAL 1 DAY")} AS window_end,
  event_type, COUNT(*) AS events, {R('SUM(value)')} AS value_sum
FROM events GROUP BY date_trunc('day', ts), event_type""")
def r02(t):
    spark = t.spark
    src = t.root
    schema = t.events.schema
    base = run_folder(spark, "r02")
    q = windowed_kpis(spark, src, schema, base + "/kpis", base + "/_checkpoint", glob="events.parquet")
    q.awaitTermination()
    return spark.read.parquet(base + "/kpis").drop("window_day")


def _late_run(t):
    """Events land in two drops: every seventh event, whatever its time, comes second. Run after each drop."""
    spark = t.spark
    base = run_folder(spark, "r02l")
    second = F.col("event_id") % 7 == 0
    for n, rows in enumerate((t.events.where(~second), t.events.where(second))):
        rows.write.parquet(f"{base}/landed/drop={n}")
        windowed_kpis(spark, f"{base}/landed/*", t.events.schema, base + "/kpis", base + "/_checkpoint").awaitTermination()
    return base + "/kpis"


_LATE = """WITH bound AS (SELECT max(ts) - INTERVAL 3 DAY AS b FROM events WHERE event_id % 7 <> 0),
late AS (SELECT events.* FROM events, bound WHERE event_id % 7 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= b)"""


@register("r02_late_rows", f"""{_LATE}
SELECT event_id, {DS('ts')} AS ts, user_id, event_type, {R('value')} AS value, 'late' AS reason FROM late""")
def r02_late(t):
    return late_rows(t.spark, _late_run(t), t.events.schema).drop("props", "batch_id")


@register("r02_kpis_without_late", f"""{_LATE}
SELECT {DS("date_trunc('day', ts)")} AS window_start, event_type, COUNT(*) AS events, {R('SUM(value)')} AS value_sum
FROM (SELECT ts, event_type, value FROM events WHERE event_id NOT IN (SELECT event_id FROM late)) GROUP BY 1, event_type""")
def r02_on_time(t):
    return t.spark.read.parquet(_late_run(t)).drop("window_day", "window_end")


@register("r01_replayed_landing", f"""
SELECT l_orderkey, l_linenumber, ship_year, {R('MAX(l_quantity)')} AS l_quantity
FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem)
GROUP BY l_orderkey, l_linenumber, ship_year""")
def r01_replayed(t):
    """The checkpoint forgets that the batch was committed, as after a crash between the table's commit and its own:
    Spark replays it, and the table, changed by hand in between, stays as it is."""
    spark = t.spark
    base = run_folder(spark, "r01r")
    schema = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").schema

    def land():
        landing_to_bronze(spark, t.root, schema, base + "/bronze", _LINE_KEYS, base + "/_checkpoint", glob="lineitem.parquet",
                          order_col="l_quantity", partition_col="ship_year", derive=lambda b: b.withColumn("ship_year", F.year("l_shipdate"))).awaitTermination()

    land()
    spark.read.parquet(base + "/bronze").drop("l_shipdate").write.parquet(base + "/copy")
    replace(spark.read.parquet(base + "/copy"), base + "/bronze", ["ship_year"])
    remove(spark, f"{base}/_checkpoint/commits")
    land()
    return spark.read.parquet(base + "/bronze")
