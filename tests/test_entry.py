import duckdb
import pytest

import __spark_entry__ as E
from mkpulse.plans.catalog import REGISTRY
from mkpulse.session import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = ["a04_channel_breakdown", "a25_campaign_performance", "j01_daily_trend", "w02_spend_anomalies",
        "n02_campaign_efficiency", "n14_exec_insights", "q01_grain_summary", "s01_search_ads_rows"]


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 150


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"channel", "spend", "clicks", "impressions", "conversions", "cpa"}
    assert df.count() >= 0


def _norm(pdf):
    import math

    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        row = []
        for v in rec:
            if hasattr(v, "item"):
                v = v.item()
            if isinstance(v, float):
                v = None if math.isnan(v) else round(v, 6)
            row.append(v)
        out.append(tuple(row))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches(spark, name):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = _norm(E.queries()[name](spark, SF).toPandas())
    want = _norm(con.execute(REGISTRY[name].sql).df())
    assert got == want


def test_contract_loads_without_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); "
            "assert set(s) <= set(q) and all(isinstance(v, str) and v.strip() for v in s.values()); print(len(q))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip().splitlines()[-1]) >= 200


def test_entry_is_the_first_call_of_a_process():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("from pyspark.sql import SparkSession; import __spark_entry__ as E; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('ROWS', E.entry(s).count())")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]
