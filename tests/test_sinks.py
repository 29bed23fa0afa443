import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from mkpulse import sinks as K

SCHEMA = "a string, b string, v int"


def test_upsert_null_safe_vs_plain(spark):
    tgt = spark.createDataFrame([("x", None, 1), ("y", "1", 2)], SCHEMA)
    bat = spark.createDataFrame([("x", None, 10)], SCHEMA)
    safe = sorted(tuple(r) for r in K.upsert_frame(tgt, bat, ["a", "b"]).collect())
    plain = sorted(tuple(r) for r in K.upsert_frame(tgt, bat, ["a", "b"], null_safe=False).collect())
    assert safe == [("x", None, 10), ("y", "1", 2)]
    assert plain == [("x", None, 1), ("x", None, 10), ("y", "1", 2)]


def test_upsert_batch_duplicates_survive_and_missing_key(spark):
    tgt = spark.createDataFrame([("x", "1", 1)], SCHEMA)
    bat = spark.createDataFrame([("x", "1", 5), ("x", "1", 6)], SCHEMA)
    assert K.upsert_frame(tgt, bat, ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        K.upsert_frame(tgt, bat.drop("b"), ["a", "b"])
    with pytest.raises(ValueError):
        K.upsert_frame(tgt, bat, [])


def test_upsert_on_disk_idempotent_and_partitioned(spark, scratch):
    path = os.path.join(scratch, "t")
    day = lambda d: dt.date(2024, 1, d)
    first = spark.createDataFrame([(day(1), "k1", 1.0), (day(2), "k2", 2.0)], "date_day date, k string, v double")
    assert K.upsert(first, path, ["date_day", "k"], partition_col="date_day")["mode"] == "create"
    batch = spark.createDataFrame([(day(2), "k2", 20.0), (day(3), "k3", 3.0)], "date_day date, k string, v double")
    K.upsert(batch, path, ["date_day", "k"], partition_col="date_day")
    K.upsert(batch, path, ["date_day", "k"], partition_col="date_day")  # replay: same result
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("k1", 1.0), ("k2", 20.0), ("k3", 3.0)]


def test_replace_empty_is_noop(spark, scratch):
    path = os.path.join(scratch, "r")
    df = spark.createDataFrame([(1,)], "x int")
    assert K.replace(df, path) == 1
    assert K.replace(df.where(F.col("x") > 5), path) == 0
    assert spark.read.parquet(path).count() == 1


def test_dedupe_in_place_duplicate_summary(spark, scratch):
    # 12 landed rows for (2026-02-02, campaign 0), one without extraction time
    rows = [("2026-02-02", 0, dt.datetime(2026, 2, 3, h), float(h)) for h in range(11)] + [("2026-02-02", 0, None, -1.0)]
    df = spark.createDataFrame(rows, "date string, campaign_id long, extracted_at timestamp, cost double")
    path = os.path.join(scratch, "dup")
    df.write.parquet(path)
    rep = K.dedupe_in_place(spark, path, ["date", "campaign_id"])
    assert rep == {"total_rows": 12, "unique_keys": 1, "duplicate_rows": 11, "deleted": 11}
    assert spark.read.parquet(path).first().cost == 10.0


def test_typed_replace_batch_last_wins(spark):
    df = spark.createDataFrame([("20240105", "", "1"), ("20240105", "7", "2")], "date string, sessions string, ord string")
    out = K.typed_replace_batch(df, ["date_day"], renames={"date": "date_day"}, date_cols=["date_day"], numeric_cols=["sessions"])
    r = out.collect()
    assert len(r) == 1 and r[0].sessions == 7.0 and r[0].date_day == dt.date(2024, 1, 5)


def test_run_goes_on_after_a_failure_and_is_audited(spark):
    def boom():
        raise OSError("boom")

    done = K.run_loads({"ads": boom, "campaigns": lambda: {"mode": "upsert", "rows_written": 5}, "keywords": lambda: {"mode": "create", "rows_written": 2}})
    a = K.audit_rows(spark, done)
    assert sorted((r.dataset, r.rows_written, r.error) for r in a.collect()) == [("ads", 0, "OSError: boom"), ("campaigns", 5, None), ("keywords", 2, None)]
    assert all(r.duration_s >= 0 for r in a.collect())
    t = K.run_totals(a).first()
    assert (t.datasets, t.failed, t.rows_written) == (3, 1, 7)


def test_recover_interrupted_swap(spark, scratch):
    path = os.path.join(scratch, "t")
    spark.createDataFrame([(1,)], "x int").write.parquet(path + ".old-deadbeef")  # died between renames
    assert K.recover(spark, path) is True
    assert spark.read.parquet(path).count() == 1
    assert K.recover(spark, path) is False


def test_stamp_is_constant_per_batch(spark):
    ts = dt.datetime(2024, 1, 30, 12, 0)
    out = K.stamp(spark.range(5), ts).select("extracted_at").distinct().collect()
    assert len(out) == 1 and out[0].extracted_at == ts
    assert K.stamp(spark.range(3)).select("extracted_at").distinct().count() == 1


def test_bucketed_facts_join_without_shuffle(spark, scratch):
    a = spark.range(1000).select((F.col("id") % 50).alias("campaign_id"), F.col("id").cast("double").alias("spend"))
    b = spark.range(200).select((F.col("id") % 50).alias("campaign_id"), F.col("id").alias("clicks"))
    K.write_bucketed(a, "t_bucket_spend", ["campaign_id"], 8, path=os.path.join(scratch, "spend"))
    K.write_bucketed(b, "t_bucket_clicks", ["campaign_id"], 8, path=os.path.join(scratch, "clicks"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_bucket_spend").join(spark.table("t_bucket_clicks"), "campaign_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 1000 * 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP TABLE IF EXISTS t_bucket_spend")
        spark.sql("DROP TABLE IF EXISTS t_bucket_clicks")


PART = "k long, y int, v string"


def table(spark, path):
    return sorted(((r.k, r.y, r.v) for r in spark.read.parquet(path).collect()), key=repr)


def test_null_partition_is_kept(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2020, "a"), (2, None, "b"), (3, None, "c")], PART), path, ["y"])
    K.upsert(spark.createDataFrame([(4, None, "d"), (2, None, "B")], PART), path, ["k", "y"], partition_col="y")
    assert table(spark, path) == [(1, 2020, "a"), (2, None, "B"), (3, None, "c"), (4, None, "d")]


def test_moved_key_leaves_its_old_partition(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2020, "a"), (2, 2021, "b"), (3, 2022, "c"), (5, None, "e")], PART), path, ["y"])
    K.upsert(spark.createDataFrame([(1, 2021, "A"), (5, 2022, "E")], PART), path, ["k"], partition_col="y")
    assert table(spark, path) == [(1, 2021, "A"), (2, 2021, "b"), (3, 2022, "c"), (5, 2022, "E")]
    assert not any(f.startswith("y=2020") for f in os.listdir(path))  # emptied


def interrupted(monkeypatch, spark, path, stop, write):
    """Run ``write`` and die at the ``stop``-th rename of a folder."""
    real, n = K._fs, [0]

    class Dying:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            n[0] += 1
            if n[0] == stop:
                raise KeyboardInterrupt
            return self.fs.rename(a, b)

    def fs(spark, path):
        f, p, jvm = real(spark, path)
        return Dying(f), p, jvm

    monkeypatch.setattr(K, "_fs", fs)
    try:
        write()
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(K, "_fs", real)
    return n[0] >= stop


@pytest.mark.parametrize("stop", range(1, 8))
def test_crash_at_any_rename_of_a_partition_upsert(spark, scratch, monkeypatch, stop):
    path = os.path.join(scratch, "t")
    before = [(1, 2020, "a"), (2, 2021, "b"), (3, 2022, "c")]
    K.replace(spark.createDataFrame(before, PART), path, ["y"])
    after = [(1, 2021, "A"), (2, 2021, "b"), (3, 2022, "c"), (4, 2022, "d")]
    batch = spark.createDataFrame([(1, 2021, "A"), (4, 2022, "d")], PART)
    died = interrupted(monkeypatch, spark, path, stop, lambda: K.upsert(batch, path, ["k"], partition_col="y"))
    finished = K.recover(spark, path)
    assert table(spark, path) == (before if died and not finished else after)
    assert sorted(f for f in os.listdir(path) if not f.startswith((".", "_"))) == [f"y={y}" for y in sorted({r[1] for r in table(spark, path)})]
    K.upsert(batch, path, ["k"], partition_col="y")  # a rerun gives the same table
    assert table(spark, path) == after and os.listdir(scratch) == ["t"]


@pytest.mark.parametrize("stop", range(1, 4))
def test_crash_at_any_rename_of_a_replace(spark, scratch, monkeypatch, stop):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2020, "a")], PART), path)
    died = interrupted(monkeypatch, spark, path, stop, lambda: K.replace(spark.createDataFrame([(2, 2021, "b")], PART), path))
    finished = K.recover(spark, path)
    assert died and table(spark, path) == ([(2, 2021, "b")] if finished else [(1, 2020, "a")])
    assert finished == (stop > 1)


def test_several_leftovers_raise(spark, scratch):
    path = os.path.join(scratch, "t")
    for n in (1, 2):
        spark.range(5).write.parquet(f"{path}.old-{n}")
    with pytest.raises(RuntimeError, match="several"):
        K.upsert(spark.range(1), path, ["id"])
    assert not os.path.exists(path)


def test_dedupe_keeps_the_partition_folders(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2020, "a"), (1, 2020, "b"), (2, 2021, "c")], PART), path, ["y"])
    assert K.dedupe_in_place(spark, path, ["k"])["deleted"] == 1
    assert K.partition_columns(spark, path) == ["y"]
    K.upsert(spark.createDataFrame([(3, 2021, "d")], PART), path, ["k", "y"], partition_col="y")
    assert [(k, y) for k, y, _ in table(spark, path)] == [(1, 2020), (2, 2021), (3, 2021)]
    with pytest.raises(ValueError, match="partitioned by"):
        K.upsert(spark.createDataFrame([(3, 2021, "d")], PART), path, ["k", "y"])


def test_empty_batch_and_single_evaluation(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2020, "a")], PART), path, ["y"])
    K.upsert(spark.createDataFrame([], PART), path, ["k", "y"], partition_col="y")
    assert table(spark, path) == [(1, 2020, "a")]
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, 2020, "x") for k in range(10)], PART)
    K.replace(rows.mapInArrow(count, PART), path, ["y"])
    K.upsert(rows.mapInArrow(count, PART), path, ["k", "y"], partition_col="y")
    assert seen.value == 20


def test_dedupe_rewrites_only_partitions_with_duplicates(spark, scratch):
    """The surplus is found without the wide columns; other partitions keep their files, special names and NULL included."""
    path = os.path.join(scratch, "t")
    schema = "k long, p string, at timestamp, v string, wide string"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, p, t0 + dt.timedelta(hours=h), f"{k}{p}{h}", "x" * 50) for k in range(5) for p in ("a b", "c/d=%", "e", None) for h in range(2 if p in ("a b", None) else 1)]
    rows += [(9, "e", None, "old", "x"), (9, "e", t0, "new", "x"), (None, "a b", t0, "n1", "x"), (None, "a b", t0 + dt.timedelta(hours=5), "n2", "x")]
    df = spark.createDataFrame(rows, schema)
    K.replace(df, path, ["p"])
    before = K.partition_stamps(spark, path)
    want = sorted((tuple(r) for r in K.dedupe(df, ["k", "p"], "at").collect()), key=repr)
    assert K.dedupe_in_place(spark, path, ["k", "p"], "at") == {"total_rows": len(rows), "unique_keys": len(want), "duplicate_rows": len(rows) - len(want), "deleted": len(rows) - len(want)}
    got = spark.read.schema(schema).parquet(path)
    assert sorted((tuple(r) for r in got.select(*df.columns).collect()), key=repr) == want
    after = K.partition_stamps(spark, path)
    assert len(before) == 4 and {f for f in before if before[f] == after[f]} == {f for f in before if f.startswith("p=c")}
    stamps = K.partition_stamps(spark, path)
    assert K.dedupe_in_place(spark, path, ["k", "p"], "at")["deleted"] == 0 and K.partition_stamps(spark, path) == stamps
    plan = K._surplus(spark.read.parquet(path), ["k", "p"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan


def test_dedupe_without_an_order_keeps_the_row_written_last(spark, scratch):
    path = os.path.join(scratch, "t")
    for v in "abc":
        spark.createDataFrame([(1, v), (ord(v), v)], "k long, v string").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file times in whole seconds on some systems
    assert K.dedupe_in_place(spark, path, ["k"])["deleted"] == 2
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "c"), (97, "a"), (98, "b"), (99, "c")]
