"""Writes that die at any file-system call, and two writers of one table."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from mkpulse import sinks as K

PART = "k long, y int, v string"
CHANGES = ("rename", "delete", "create", "mkdirs")


class Crash(BaseException):
    pass


class Dying:
    """A file system whose ``stop``-th change, and all after it, kill the caller: before the change or after it.

    A folder that dies while it is deleted has lost some of its content.
    """

    def __init__(self, fs, state):
        self.fs, self.state = fs, state

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name not in CHANGES:
            return real

        def call(*args):
            s = self.state
            s["n"] += 1
            if s["n"] < s["stop"]:
                return real(*args)
            if s["n"] == s["stop"] and s["after"]:
                if name == "delete" and args[1]:
                    for c in sorted(self.fs.listStatus(args[0]), key=lambda c: c.getPath().getName(), reverse=True)[:1]:
                        self.fs.delete(c.getPath(), True)
                else:
                    real(*args)
            raise Crash

        return call


def dying(monkeypatch, stop, after, write):
    """Run ``write`` with the ``stop``-th change deadly; True if it got that far."""
    real, state = K._fs, {"n": 0, "stop": stop, "after": after}

    def fs(spark, path):
        f, p, jvm = real(spark, path)
        return Dying(f, state), p, jvm

    monkeypatch.setattr(K, "_fs", fs)
    try:
        write()
    except Crash:
        pass
    finally:
        monkeypatch.setattr(K, "_fs", real)
    return state["n"] >= stop


def table(spark, path):
    return sorted(((r.k, r.y, r.v) for r in spark.read.parquet(path).collect()), key=repr) if os.path.exists(path) else None


def at_every_call(spark, scratch, monkeypatch, before, write, after, entry=None):
    """Die at each change of ``write`` in turn; then a recovered table must be ``before`` or ``after``, and a rerun gives ``after``."""
    seen = set()
    monkeypatch.setattr(K, "HALF_MADE_S", 0)
    for late in (False, True):
        for stop in range(1, 60):
            path = os.path.join(scratch, f"t-{late}-{stop}")
            if before:
                K.replace(spark.createDataFrame(before, PART).coalesce(1), path, ["y"])
            died = dying(monkeypatch, stop, late, lambda path=path: write(path))
            for _ in range(2):  # recovery itself may be repeated
                K.recover(spark, path)
                got = table(spark, path)
                assert got in (before, after), (late, stop)
            if entry:
                assert (K.ledger(spark, path) == entry) == (got == after), (late, stop)
            seen.add(got == after)
            assert [f for f in os.listdir(scratch) if f.startswith(f"t-{late}-{stop}.") and not f.endswith(".ledger")] == [], (late, stop)
            if stop % 5 == 0 or not died:
                write(path)
                assert table(spark, path) == after
            if not died:
                break
        assert not died
    assert seen == {True, False}


BEFORE = [(1, 2020, "a"), (2, 2021, "b")]


def test_upsert_that_adds_moves_and_empties_partitions(spark, scratch, monkeypatch):
    batch = spark.createDataFrame([(1, 2021, "A"), (4, 2025, "d")], PART).coalesce(1)
    at_every_call(spark, scratch, monkeypatch, BEFORE, lambda path: K.upsert(batch, path, ["k"], partition_col="y", entry={"s": 7}),
                  [(1, 2021, "A"), (2, 2021, "b"), (4, 2025, "d")], {"s": 7})


def test_first_write(spark, scratch, monkeypatch):
    batch = spark.createDataFrame(BEFORE, PART).coalesce(1)
    at_every_call(spark, scratch, monkeypatch, None, lambda path: K.replace(batch, path, ["y"]), BEFORE)


def test_replace_of_a_table(spark, scratch, monkeypatch):
    batch = spark.createDataFrame([(9, 2030, "z")], PART).coalesce(1)
    at_every_call(spark, scratch, monkeypatch, BEFORE, lambda path: K.replace(batch, path, ["y"]), [(9, 2030, "z")])


def test_write_of_one_partition(spark, scratch, monkeypatch):
    rows = spark.createDataFrame([(5, "n")], "k long, v string").coalesce(1)
    at_every_call(spark, scratch, monkeypatch, BEFORE, lambda path: K.write_partition(rows, path, "y", 2022), [*BEFORE, (5, 2022, "n")])


def test_dedupe_in_place(spark, scratch, monkeypatch):
    twice = [(1, 2020, "a"), (1, 2020, "b")]
    at_every_call(spark, scratch, monkeypatch, twice, lambda path: K.dedupe_in_place(spark, path, ["k"], "v"), [(1, 2020, "b")])


def test_crash_while_the_old_folders_are_deleted(spark, scratch, monkeypatch):
    """The committed folders of the table are never taken for old ones, whatever is left of the swap folder."""
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame([(1, 2024, "a")], PART), path, ["y"])
    monkeypatch.setattr(K, "HALF_MADE_S", 0)
    batch = spark.createDataFrame([(1, 2024, "A"), (2, 2025, "b")], PART)
    for stop in range(1, 40):
        if not dying(monkeypatch, stop, True, lambda: K.upsert(batch, path, ["k"], partition_col="y")):
            break
        K.recover(spark, path)
    assert table(spark, path) == [(1, 2024, "A"), (2, 2025, "b")]


def test_second_writer_gets_an_error(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame(BEFORE, PART), path, ["y"])
    inside, go_on, result = threading.Event(), threading.Event(), []

    def slow(scope, batch):
        inside.set()
        assert go_on.wait(60)
        return K.upsert_frame(scope, batch, ["k"])

    def first():
        result.append(K.upsert(spark.createDataFrame([(3, 2022, "c")], PART), path, ["k"], partition_col="y", combine=slow))

    t = threading.Thread(target=first)
    t.start()
    assert inside.wait(60)
    other = spark.createDataFrame([(4, 2023, "d")], PART)
    for write in (lambda: K.upsert(other, path, ["k"], partition_col="y"), lambda: K.replace(other, path), lambda: K.recover(spark, path),
                  lambda: K.dedupe_in_place(spark, path, ["k"]), lambda: K.write_partition(other.drop("y"), path, "y", 1)):
        with pytest.raises(K.TableBusy):
            write()
    go_on.set()
    t.join()
    assert result and table(spark, path) == [*BEFORE, (3, 2022, "c")]
    K.upsert(other, path, ["k"], partition_col="y")
    assert table(spark, path) == [*BEFORE, (3, 2022, "c"), (4, 2023, "d")] and os.listdir(scratch) == ["t"]


def test_lease_of_another_application_runs_out(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    with open(path + ".lease", "w") as f:
        f.write("app-elsewhere 12")
    with pytest.raises(K.TableBusy, match="app-elsewhere"):
        K.replace(spark.createDataFrame(BEFORE, PART), path, ["y"])
    monkeypatch.setattr(K, "LEASE_S", 1)
    time.sleep(1.5)
    K.replace(spark.createDataFrame(BEFORE, PART), path, ["y"])
    assert table(spark, path) == BEFORE


def test_writer_that_lost_its_lease_does_not_commit(spark, scratch):
    path = os.path.join(scratch, "t")
    K.replace(spark.createDataFrame(BEFORE, PART), path, ["y"])

    def taken_over(scope, batch):
        fs, p, _ = K._fs(spark, path + ".lease")
        K._write(fs, p, "app-other 1", overwrite=True)
        return batch

    with pytest.raises(K.TableBusy, match="took"):
        K.upsert(spark.createDataFrame([(1, 2020, "lost")], PART), path, ["k"], partition_col="y", combine=taken_over)
    assert table(spark, path) == BEFORE and os.path.exists(path + ".lease")  # the other's lease stays


def test_lease_is_renewed_while_a_write_lives(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    monkeypatch.setattr(K, "LEASE_S", 2)

    def slow(scope, batch):
        fs, p, _ = K._fs(spark, path + ".lease")
        began = fs.getFileStatus(p).getModificationTime()
        time.sleep(3)
        assert fs.getFileStatus(p).getModificationTime() > began
        return batch

    K.replace(spark.createDataFrame(BEFORE, PART), path)
    K.upsert(spark.createDataFrame([(9, 1, "x")], PART), path, ["k"], combine=slow)
    assert table(spark, path) == [(9, 1, "x")]


def test_ledger_and_combine(spark, scratch):
    path = os.path.join(scratch, "t")

    def add(rows, batch):
        return rows.unionByName(batch).groupBy("k", "y").agg(F.concat_ws("", F.sort_array(F.collect_list("v"))).alias("v"))

    for n, v in enumerate("abc"):
        K.upsert(spark.createDataFrame([(1, 2020, v)], PART), path, ["k"], partition_col="y", combine=add, entry={"s": n, f"x{n}": n})
    assert table(spark, path) == [(1, 2020, "abc")] and K.ledger(spark, path) == {"s": 2, "x0": 0, "x1": 1, "x2": 2}
    K.replace(spark.createDataFrame([], PART), path, entry={"s": 3})
    assert table(spark, path) == [(1, 2020, "abc")] and K.ledger(spark, path)["s"] == 3
