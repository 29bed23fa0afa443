"""Registered queries: the on-disk write path K01/K02/K05/K08.

Each query writes driver-derived tables into a fresh folder under the
session's shared checkpoint folder, runs the write operator there, and reads
the resulting table back, so the staging / swap / partition-scoped code runs
end to end on data that grows with the driver tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mkpulse import sinks as K
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register
from mkpulse.streaming import run_folder

_KEYS = ["l_orderkey", "l_linenumber"]


def _lines(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.year("l_shipdate").alias("ship_year"), "l_shipdate")


@register("k02_partitioned_upsert_on_disk", f"""
WITH tgt AS (SELECT l_orderkey, l_linenumber, l_quantity, 0 AS landed_day, CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem),
bat AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, 1 AS landed_day, CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-08-03 00:00:00')
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, landed_day, ship_year FROM tgt
WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = tgt.l_orderkey AND bat.l_linenumber = tgt.l_linenumber
  AND bat.ship_year = tgt.ship_year)
UNION ALL SELECT l_orderkey, l_linenumber, {R('l_quantity')}, landed_day, ship_year FROM bat""")
def k02(t):
    spark = t.spark
    base = run_folder(spark, "k02") + "/lines"
    lines = _lines(t)
    K.load(lines.select(*_KEYS, "l_quantity", F.lit(0).alias("landed_day"), "ship_year"), base, _KEYS + ["ship_year"],
           lifetime=True, partition_col="ship_year")  # K08 lifetime -> K01 replace
    batch = lines.where(F.col("l_shipdate") >= F.lit("2001-08-03").cast("timestamp")).select(
        *_KEYS, (F.col("l_quantity") + 1).alias("l_quantity"), F.lit(1).alias("landed_day"), "ship_year")
    K.load(batch, base, _KEYS + ["ship_year"], lifetime=False, partition_col="ship_year")  # K08 incremental -> K02
    return spark.read.parquet(base)


@register("k05_dedupe_in_place", f"""
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, {R('l_extendedprice')} AS l_extendedprice,
  {DS('extracted_at')} AS extracted_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY extracted_at DESC NULLS LAST, l_quantity DESC, l_extendedprice DESC) AS rn FROM dup_lines) WHERE rn = 1""",
          ["dup_lines"])
def k05(t):
    spark = t.spark
    path = run_folder(spark, "k05") + "/dup_lines"
    ad.dup_lines(t).write.parquet(path)
    K.dedupe_in_place(spark, path, _KEYS, "extracted_at", ["l_quantity", "l_extendedprice"])
    return spark.read.parquet(path)


#: Lines whose year is even lose their partition value; the batch moves keys by a year and reaches some NULL ones.
_YEAR = "CASE WHEN year(l_shipdate) % 2 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INTEGER) END"


@register("k02_null_partition_upsert", f"""
WITH lines AS (SELECT l_orderkey, l_linenumber, l_quantity, {_YEAR} AS ship_year FROM lineitem),
bat AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, ship_year FROM lines WHERE l_orderkey % 7 = 0)
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, CAST(ship_year AS VARCHAR) AS ship_year FROM lines
WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = lines.l_orderkey AND bat.l_linenumber = lines.l_linenumber
  AND bat.ship_year IS NOT DISTINCT FROM lines.ship_year)
UNION ALL SELECT l_orderkey, l_linenumber, {R('l_quantity')}, CAST(ship_year AS VARCHAR) FROM bat""")
def k02_null(t):
    spark = t.spark
    base = run_folder(spark, "k02n") + "/lines"
    year = F.when(F.year("l_shipdate") % 2 == 0, F.lit(None)).otherwise(F.year("l_shipdate")).cast("int")
    lines = t.lineitem.select(*_KEYS, "l_quantity", year.alias("ship_year"))
    K.replace(lines, base, ["ship_year"])
    batch = lines.where(F.col("l_orderkey") % 7 == 0).withColumn("l_quantity", F.col("l_quantity") + 1)
    K.upsert(batch, base, [*_KEYS, "ship_year"], partition_col="ship_year")
    return spark.read.parquet(base).withColumn("ship_year", F.col("ship_year").cast("string"))


@register("k02_moving_key_upsert", f"""
WITH lines AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem),
bat AS (SELECT l_orderkey, l_linenumber, l_quantity, ship_year + 1 AS ship_year FROM lines WHERE l_orderkey % 5 = 0)
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, ship_year FROM lines
WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = lines.l_orderkey AND bat.l_linenumber = lines.l_linenumber)
UNION ALL SELECT l_orderkey, l_linenumber, {R('l_quantity')}, ship_year FROM bat""")
def k02_moving(t):
    spark = t.spark
    base = run_folder(spark, "k02m") + "/lines"
    lines = _lines(t).drop("l_shipdate")
    K.replace(lines, base, ["ship_year"])
    K.upsert(lines.where(F.col("l_orderkey") % 5 == 0).withColumn("ship_year", F.col("ship_year") + 1), base, _KEYS, partition_col="ship_year")
    return spark.read.parquet(base)


@register("k04_typed_replace", f"""
SELECT l_orderkey AS order_key, CAST(l_shipdate AS VARCHAR)[:10] AS date_day, {R('MAX(l_quantity)')} AS l_quantity
FROM lineitem GROUP BY l_orderkey, CAST(l_shipdate AS VARCHAR)[:10]""")
def k04(t):
    # landed as strings, one row per line; the largest quantity of an order and day lands last
    landed = t.lineitem.groupBy("l_orderkey", F.date_format("l_shipdate", "yyyyMMdd").alias("date")).agg(
        F.sort_array(F.collect_list("l_quantity")).alias("q"))
    landed = landed.select(F.col("l_orderkey").alias("orderKey"), "date", F.explode("q").alias("l_quantity"))
    return K.typed_replace_batch(landed.withColumn("l_quantity", F.col("l_quantity").cast("string")), ["order_key", "date_day"],
                                 renames={"orderKey": "order_key", "date": "date_day"}, date_cols=["date_day"], numeric_cols=["l_quantity"])


@register("k03_plain_key_upsert", f"""
WITH tgt AS (SELECT l_orderkey, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS l_linenumber, l_quantity FROM lineitem),
bat AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity FROM tgt WHERE l_orderkey % 3 = 0)
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity FROM tgt
WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = tgt.l_orderkey AND bat.l_linenumber = tgt.l_linenumber)
UNION ALL SELECT l_orderkey, l_linenumber, {R('l_quantity')} FROM bat""")
def k03(t):
    """NULL keys match nothing here: their rows stay, and the batch's come beside them."""
    number = F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("l_linenumber")
    tgt = t.lineitem.select("l_orderkey", number, "l_quantity")
    batch = tgt.where(F.col("l_orderkey") % 3 == 0).withColumn("l_quantity", F.col("l_quantity") + 1)
    return K.upsert_frame(tgt, batch, _KEYS, null_safe=False)


@register("k06_stamped_batches", """
SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN '2024-01-31 06:00:00' ELSE '2024-01-30 06:00:00' END AS extracted_at, COUNT(*) AS n
FROM lineitem GROUP BY 1, 2""")
def k06(t):
    """Two loads of one table, each with one extraction time on all of its rows."""
    li, path = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), run_folder(t.spark, "k06") + "/lines"
    K.load(K.stamp(li, dt.datetime(2024, 1, 30, 6)), path, _KEYS, lifetime=True)
    again = K.stamp(li.where(F.col("l_returnflag") == "A"), dt.datetime(2024, 1, 31, 6))
    K.upsert(again, path, [*_KEYS, "l_returnflag"], combine=lambda rows, batch: rows.where(F.col("l_returnflag") != "A").unionByName(batch))
    return t.spark.read.parquet(path).groupBy("l_returnflag", "extracted_at").agg(F.count(F.lit(1)).alias("n"))


@register("k07_run_audit", """
SELECT * FROM (SELECT 'lines' AS dataset, 'replace' AS mode, COUNT(*) AS rows_written, CAST(NULL AS VARCHAR) AS error, 2 AS datasets, 1 AS failed
  FROM lineitem UNION ALL SELECT 'nothing', NULL, 0, 'ValueError: upsert needs key columns present on both sides; missing all', 2, 1)""")
def k07(t):
    """A run of two loads of which one fails: the other's rows are written, both are audited."""
    path, li = run_folder(t.spark, "k07") + "/lines", t.lineitem.select(*_KEYS)

    def fails():
        return K.upsert_frame(li, li, []).count()

    audit = K.audit_rows(t.spark, K.run_loads({"lines": lambda: K.load(li, path, _KEYS, lifetime=True), "nothing": fails}), dt.datetime(2024, 1, 30))
    return audit.join(K.run_totals(audit).drop("rows_written", "duration_s"), "run_ts").select(
        "dataset", "mode", "rows_written", "error", F.col("datasets").cast("int").alias("datasets"), F.col("failed").cast("int").alias("failed"))


@register("k08_recovered_load", f"""
SELECT l_orderkey, l_linenumber, {R('l_quantity + CASE WHEN year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem) THEN 1 ELSE 0 END')}
  AS l_quantity, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem""")
def k08_recovered(t):
    """A load that adds a partition ends with its commit, before the first folder moves; recovery finishes it, and recovering
    again takes nothing away."""
    spark, path = t.spark, run_folder(t.spark, "k08") + "/lines"
    lines = _lines(t).drop("l_shipdate")
    newest = lines.select(F.max("ship_year")).scalar()
    K.load(lines.where(F.col("ship_year") < newest), path, [*_KEYS, "ship_year"], lifetime=True, partition_col="ship_year")
    batch = lines.where(F.col("ship_year") == newest).withColumn("l_quantity", F.col("l_quantity") + 1)
    K.upsert(batch, path, [*_KEYS, "ship_year"], partition_col="ship_year", exchange=False)
    K.recover(spark, path)
    K.recover(spark, path)
    return spark.read.parquet(path)
