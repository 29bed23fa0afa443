"""Registered queries: data-quality checks Q01-Q07 and the catalog S24."""

from __future__ import annotations

from pyspark.sql import functions as F

from mkpulse import sinks as K
from mkpulse.operators import grain_ledger as G
from mkpulse.operators import quality as Q
from mkpulse.plans import adapters as ad
from mkpulse.plans.catalog import DS, R, register
from mkpulse.streaming import run_folder

# grains of the derived tables checked here
DQ_GRAINS = {
    "dup_lines": ("l_orderkey", "l_linenumber"),
    "web_traffic": ("date_day", "sessionSource", "sessionMedium", "sessionCampaignName"),
    "orders": ("o_orderkey",),
}
_KEYS = "l_orderkey, l_linenumber"
_DUPG = f"g AS (SELECT {_KEYS}, COUNT(*) AS row_count FROM dup_lines GROUP BY {_KEYS} HAVING COUNT(*) > 1)"


def _dq_tables(t):
    return {"dup_lines": ad.dup_lines(t), "web_traffic": ad.web_traffic(t), "orders": t.orders}


@register("q01_grain_summary", f"""
WITH {_DUPG}
SELECT 'dup_lines' AS "table", 'l_orderkey,l_linenumber' AS key_columns, COUNT(*) AS duplicate_groups,
  CAST(COALESCE(SUM(row_count - 1), 0) AS BIGINT) AS duplicate_rows, CAST(NULL AS VARCHAR) AS error FROM g""", ["dup_lines"])
def q01(t):
    return Q.grain_summary(ad.dup_lines(t), DQ_GRAINS["dup_lines"], "dup_lines")


@register("q01_grain_samples", f"""
WITH {_DUPG}
SELECT {_KEYS}, row_count FROM g ORDER BY row_count DESC, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST LIMIT 5""",
          ["dup_lines"])
def q01s(t):
    return Q.grain_samples(ad.dup_lines(t), DQ_GRAINS["dup_lines"])


def _grain_sql(name: str, keys: tuple[str, ...]) -> str:
    k = ", ".join(keys)
    return f"""SELECT '{name}' AS "table", '{",".join(keys)}' AS key_columns, COUNT(*) AS duplicate_groups,
  CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT {k}, COUNT(*) AS c FROM {name} GROUP BY {k} HAVING COUNT(*) > 1)"""


@register("q02_all_grains", "\nUNION ALL\n".join(_grain_sql(n, k) for n, k in sorted(DQ_GRAINS.items())),
          ["dup_lines", "web_traffic"])
def q02(t):
    return Q.validate_all(_dq_tables(t), DQ_GRAINS)


@register("q03_null_keys", """
WITH c AS (SELECT COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS a, COUNT(*) FILTER (WHERE l_linenumber IS NULL) AS b,
  COUNT(*) FILTER (WHERE extracted_at IS NULL) AS e FROM dup_lines)
SELECT * FROM (SELECT 'dup_lines' AS "table", 'l_orderkey' AS "column", a AS null_count FROM c
  UNION ALL SELECT 'dup_lines', 'l_linenumber', b FROM c UNION ALL SELECT 'dup_lines', 'extracted_at', e FROM c)
WHERE null_count > 0""", ["dup_lines"])
def q03(t):
    return Q.null_keys(ad.dup_lines(t), ["l_orderkey", "l_linenumber", "extracted_at"], "dup_lines")


def _report_sql(name: str, keys: tuple[str, ...]) -> str:
    k = ", ".join(keys)
    nulls = ", ".join(f"MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n{i}" for i, c in enumerate(keys))
    nk = "concat_ws(',', " + ", ".join(f"CASE WHEN MAX(n{i}) = 1 THEN '{c}' END" for i, c in enumerate(keys)) + ")"
    return f"""SELECT '{name}' AS "table", CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count,
  COALESCE(SUM(CASE WHEN n > 1 THEN n - 1 END), 0) = 0 AS grain_ok,
  CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS duplicate_rows, {nk} AS null_key_columns
  FROM (SELECT {k}, COUNT(*) AS n, {nulls} FROM {name} GROUP BY {k})"""


@register("q04_dq_report", "\nUNION ALL\n".join(_report_sql(n, k) for n, k in sorted(DQ_GRAINS.items())),
          ["dup_lines", "web_traffic"])
def q04(t):
    return Q.dq_report(_dq_tables(t), DQ_GRAINS)


@register("q05_duplicate_profile", f"""
SELECT COUNT(*) AS total_rows, COUNT(DISTINCT ({_KEYS})) AS unique_keys, COUNT(*) - COUNT(DISTINCT ({_KEYS})) AS duplicate_rows
FROM dup_lines""", ["dup_lines"])
def q05(t):
    return Q.duplicate_profile(ad.dup_lines(t), DQ_GRAINS["dup_lines"])


_AVAIL = ("customer", "events", "lineitem", "orders", "part")


@register("q06_availability", "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS \"table\", TRUE AS present, (SELECT COUNT(*) > 0 FROM (SELECT 1 FROM {n} LIMIT 1)) AS has_data" for n in _AVAIL]
    + ["SELECT 'ga4_sessions', FALSE, FALSE"]))
def q06(t):
    tabs = {n: t[n] for n in _AVAIL}
    tabs["ga4_sessions"] = None  # declared source that was never landed
    return Q.availability(tabs)


@register("q07_time_series", f"""
SELECT {DS("CAST(strptime(date, '%Y%m%d') AS DATE)")} AS date, {R('CAST(sessions AS DOUBLE)')} AS sessions
FROM web_sessions_raw""", ["web_sessions_raw"])
def q07(t):
    return Q.validate_time_series(ad.web_sessions_raw(t), "date", ["sessions"])


@register("s24_row_counts", """
SELECT 'customer' AS "table", COUNT(*) AS row_count FROM customer UNION ALL SELECT 'events', COUNT(*) FROM events
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem UNION ALL SELECT 'orders', COUNT(*) FROM orders""")
def s24_rows(t):
    from mkpulse.sources.catalog import row_counts

    return row_counts({name: t[name] for name in ("customer", "events", "lineitem", "orders")})


@register("s24_source_coverage", f"""
SELECT 'search_ads' AS source, COUNT(*) AS row_count, {DS('MIN(date_day)')} AS min_date, {DS('MAX(date_day)')} AS max_date,
  CASE WHEN COUNT(*) > 0 THEN 'loaded' ELSE 'empty' END AS status FROM ads_lean WHERE platform = 'google_ads'
UNION ALL SELECT 'social_ads', COUNT(*), {DS('MIN(date_day)')}, {DS('MAX(date_day)')},
  CASE WHEN COUNT(*) > 0 THEN 'loaded' ELSE 'empty' END FROM ads_lean WHERE platform = 'meta_ads'
UNION ALL SELECT 'organic', COUNT(*), {DS('MIN(date_day)')}, {DS('MAX(date_day)')},
  CASE WHEN COUNT(*) > 0 THEN 'loaded' ELSE 'empty' END FROM organic_daily
UNION ALL SELECT 'web', COUNT(*), {DS("MIN(CAST(strptime(date, '%Y%m%d') AS DATE))")},
  {DS("MAX(CAST(strptime(date, '%Y%m%d') AS DATE))")}, CASE WHEN COUNT(*) > 0 THEN 'loaded' ELSE 'empty' END
  FROM web_sessions_raw""", ["ads_lean", "organic_daily", "web_sessions_raw"])
def s24(t):
    from mkpulse.sources.catalog import coverage

    paid = ad.ads(t, dims=False)
    return coverage({
        "search_ads": (paid.where(F.col("platform") == "google_ads"), "date_day"),
        "social_ads": (paid.where(F.col("platform") == "meta_ads"), "date_day"),
        "organic": (ad.organic_daily(t), "date_day"),
        "web": (ad.web_sessions_raw(t), "date"),
    })


@register("q04_incremental_report", """
WITH lines AS (SELECT l_orderkey, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem),
bat AS (SELECT DISTINCT l_orderkey, l_linenumber, ship_year FROM lines WHERE ship_year = (SELECT max(ship_year) FROM lines) AND l_orderkey % 2 = 0),
tab AS (SELECT * FROM lines WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.l_orderkey = lines.l_orderkey
    AND bat.l_linenumber IS NOT DISTINCT FROM lines.l_linenumber AND bat.ship_year = lines.ship_year)
  UNION ALL SELECT * FROM bat UNION ALL SELECT * FROM bat),
g AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM tab GROUP BY 1, 2)
SELECT 'lines' AS "table", (SELECT COUNT(*) FROM tab) AS row_count, COALESCE(SUM(n - 1), 0) = 0 AS grain_ok,
  COUNT(CASE WHEN n > 1 THEN 1 END) AS duplicate_groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows,
  CASE WHEN COUNT(CASE WHEN l_linenumber IS NULL THEN 1 END) > 0 THEN 'l_linenumber' ELSE '' END AS null_key_columns,
  TRUE AS read_one_partition FROM g""")
def q04_incremental(t):
    """A full pass over a table by year, an upsert of doubled rows into its last year, and a pass that reads that year alone."""
    base, keys = run_folder(t.spark, "q04i"), ["l_orderkey", "l_linenumber"]
    number = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("l_linenumber")
    lines = t.lineitem.select("l_orderkey", number, F.year("l_shipdate").alias("ship_year"))
    K.replace(lines, base + "/lines", ["ship_year"])
    G.refresh_grain_ledger(t.spark, base + "/lines", base + "/ledger", keys, "ship_year")
    last = lines.where((F.col("ship_year") == lines.select(F.max("ship_year")).scalar()) & (F.col("l_orderkey") % 2 == 0))
    # a key counts as one row however often the batch has it: each of its rows is landed twice
    K.upsert(last.distinct().unionAll(last.distinct()), base + "/lines", [*keys, "ship_year"], partition_col="ship_year")
    read = G.refresh_grain_ledger(t.spark, base + "/lines", base + "/ledger", keys, "ship_year")
    return G.grain_report(t.spark, base + "/ledger", "lines").withColumn("read_one_partition", F.lit(len(read) == 1))
