import datetime as dt
import os

from mkpulse.streaming import landing_to_bronze, late_rows, run_folder, windowed_kpis


def test_landing_replay_is_idempotent(spark, scratch):
    land = os.path.join(scratch, "landing")
    schema = "k long, v double, extracted_at timestamp"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 1.0, t0), (2, 2.0, t0)], schema).write.parquet(land + "/b1")
    spark.createDataFrame([(2, 20.0, t0 + dt.timedelta(hours=1)), (2, 19.0, t0)], schema).write.parquet(land + "/b2")
    base = run_folder(spark, "t-r01")
    sch = spark.read.parquet(land + "/b1").schema
    q = landing_to_bronze(spark, land + "/*", sch, base + "/bronze", ["k"], base + "/ck", max_files_per_trigger=1)
    q.awaitTermination()
    got = sorted((r.k, r.v) for r in spark.read.parquet(base + "/bronze").collect())
    assert got == [(1, 1.0), (2, 20.0)]
    q2 = landing_to_bronze(spark, land + "/*", sch, base + "/bronze", ["k"], base + "/ck2")  # full replay
    q2.awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(base + "/bronze").collect()) == got


def test_windowed_kpis(spark, scratch):
    src = os.path.join(scratch, "events")
    rows = [(dt.datetime(2024, 1, 1, 5), "view", 1.0), (dt.datetime(2024, 1, 1, 9), "view", 2.0), (dt.datetime(2024, 1, 2, 1), "click", 3.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(src)
    base = run_folder(spark, "t-r02")
    q = windowed_kpis(spark, src, spark.read.parquet(src).schema, base + "/k", base + "/ck")
    q.awaitTermination()
    got = sorted((str(r.window_start)[:10], r.event_type, r.events, r.value_sum) for r in spark.read.parquet(base + "/k").collect())
    assert got == [("2024-01-01", "view", 2, 3.0), ("2024-01-02", "click", 1, 3.0)]


EVENTS = "ts timestamp, event_type string, value double"


def test_late_rows_are_kept_over_many_batches(spark, scratch):
    """One late row in every micro-batch after the first: all are stored, none is counted in a window."""
    src, base, n = os.path.join(scratch, "events"), run_folder(spark, "t-late"), 12
    day = dt.datetime(2024, 3, 1)
    for k in range(n + 1):
        rows = [(day + dt.timedelta(hours=k), "view", 1.0)] + ([(day - dt.timedelta(days=30 + k), f"late{k}", 2.0)] * 2 if k else [])
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{src}/b{k:03d}")
        os.utime(next(os.path.join(f"{src}/b{k:03d}", f) for f in os.listdir(f"{src}/b{k:03d}") if f.startswith("part")), (1e9 + k, 1e9 + k))
    schema = spark.read.parquet(src + "/b000").schema
    q = windowed_kpis(spark, src + "/*", schema, base + "/k", base + "/ck", max_files_per_trigger=1)
    q.awaitTermination()
    late = late_rows(spark, base + "/k", schema)
    assert sorted((r.event_type, r.value, r.reason) for r in late.collect()) == sorted([(f"late{k}", 2.0, "late") for k in range(1, n + 1)] * 2)
    assert late.select("batch_id").distinct().count() == n
    assert [(r.events, r.value_sum) for r in spark.read.parquet(base + "/k").collect()] == [(n + 1, n + 1.0)]
    assert os.path.isdir(base + "/k/window_day=2024-03-01")


def test_rows_without_time_and_restart(spark, scratch):
    """The watermark outlives the run, rows without a time are kept aside, and a table without late rows reads as empty."""
    src, base = os.path.join(scratch, "events"), run_folder(spark, "t-late2")
    day = dt.datetime(2024, 3, 1)
    schema = spark.createDataFrame([], EVENTS).schema

    def run(name, rows):
        spark.createDataFrame(rows, EVENTS).write.parquet(f"{src}/{name}")
        windowed_kpis(spark, src + "/*", schema, base + "/k", base + "/ck").awaitTermination()
        return sorted(((r.event_type, r.reason) for r in late_rows(spark, base + "/k", schema).collect()))

    assert run("a", [(day, "view", 1.0), (day - dt.timedelta(days=90), "old", 1.0)]) == []  # nothing was seen before
    assert run("b", [(None, "view", 1.0), (day - dt.timedelta(days=2), "view", None)]) == [("view", "no time")]
    # a window that ended exactly at the watermark is closed, a later one is open
    assert run("c", [(day - dt.timedelta(days=4), "shut", 5.0), (day - dt.timedelta(days=4, hours=-24), "open", 5.0)]) == [("shut", "late"), ("view", "no time")]
    got = sorted((r.event_type, str(r.window_start)[:10], r.events, r.value_sum) for r in spark.read.parquet(base + "/k").collect())
    assert got == [("old", "2023-12-02", 1, 1.0), ("open", "2024-02-27", 1, 5.0), ("view", "2024-02-28", 1, None), ("view", "2024-03-01", 1, 1.0)]


class Crash(Exception):
    pass


def forget_last_commit(checkpoint):
    """What a crash leaves that comes after the table's commit and before the checkpoint's."""
    folder = checkpoint + "/commits"
    for f in sorted((f for f in os.listdir(folder) if f.strip(".crc").isdigit() or f.endswith(".crc")), reverse=True):
        os.remove(os.path.join(folder, f))


def test_replayed_batch_of_kpis_adds_nothing(spark, scratch):
    src, base = os.path.join(scratch, "events"), run_folder(spark, "t-replay")
    day = dt.datetime(2024, 3, 1)
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        windowed_kpis(spark, src + "/*", schema, base + "/k", base + "/ck").awaitTermination()
        return sorted((r.event_type, r.events, r.value_sum) for r in spark.read.parquet(base + "/k").collect())

    spark.createDataFrame([(day, "view", 1.0)] * 5, EVENTS).write.parquet(src + "/a")
    assert run() == [("view", 5, 5.0)]
    forget_last_commit(base + "/ck")
    assert run() == [("view", 5, 5.0)]  # summed once
    spark.createDataFrame([(day, "view", 1.0)] * 2, EVENTS).write.parquet(src + "/b")
    assert run() == [("view", 7, 7.0)]


def test_crash_between_late_rows_and_windows(spark, scratch, monkeypatch):
    """The late rows of a batch are committed first; the replay puts them into the same folder again."""
    import mkpulse.streaming as S

    src, base = os.path.join(scratch, "events"), run_folder(spark, "t-between")
    day = dt.datetime(2024, 3, 1)
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        windowed_kpis(spark, src + "/*", schema, base + "/k", base + "/ck").awaitTermination()

    spark.createDataFrame([(day, "view", 1.0)], EVENTS).write.parquet(src + "/a")
    run()
    spark.createDataFrame([(day, "view", 1.0), (day - dt.timedelta(days=9), "late", 1.0)], EVENTS).write.parquet(src + "/b")
    real = S.upsert

    def dies(*args, **kwargs):
        raise Crash

    monkeypatch.setattr(S, "upsert", dies)
    try:
        run()
        raise AssertionError("the crash should end the query")
    except Exception as e:  # noqa: BLE001 - Spark wraps it
        assert "Crash" in str(e)
    monkeypatch.setattr(S, "upsert", real)
    assert late_rows(spark, base + "/k", schema).count() == 1
    run()
    assert late_rows(spark, base + "/k", schema).count() == 1
    assert [(r.event_type, r.events) for r in spark.read.parquet(base + "/k").collect()] == [("view", 2)]


def test_replayed_landing_changes_nothing_without_an_order(spark, scratch):
    """Without an order column the batch wins: a replay would undo what other writers did since."""
    from mkpulse import sinks as K

    land, base = os.path.join(scratch, "landing"), run_folder(spark, "t-exact")
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double").write.parquet(land + "/b1")
    sch = spark.read.parquet(land + "/b1").schema

    def run(ck):
        landing_to_bronze(spark, land + "/*", sch, base + "/bronze", ["k"], base + ck).awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(base + "/bronze").collect())

    assert run("/ck") == [(1, 1.0), (2, 2.0)]
    fixed = spark.read.parquet(base + "/bronze").where("k = 2").selectExpr("k", "v * 100 AS v", "extracted_at")
    K.upsert(fixed, base + "/bronze", ["k"])
    forget_last_commit(base + "/ck")
    assert run("/ck") == [(1, 1.0), (2, 200.0)]
    assert run("/another") == [(1, 1.0), (2, 2.0)]  # a new checkpoint is a new stream, not a replay


def test_rows_that_land_again_are_dropped_by_state(spark, scratch):
    land, base = os.path.join(scratch, "landing"), run_folder(spark, "t-state")
    t0 = dt.datetime(2024, 1, 1)
    schema = "k long, v double, extracted_at timestamp"
    for n, rows in enumerate([[(1, 1.0, t0), (2, 2.0, t0)], [(1, 9.0, t0), (3, 3.0, t0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{land}/b{n}")
        landing_to_bronze(spark, land + "/*", spark.read.parquet(land + "/b0").schema, base + "/bronze", ["k"], base + "/ck",
                          distinct_within=("extracted_at", "2 days")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(base + "/bronze").collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
