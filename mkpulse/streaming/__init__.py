"""Structured Streaming operators R01-R02.

The reference has no stream; its incremental loads re-pull a lookback window
and upsert. Here that becomes:

* R01 ``landing_to_bronze``: a file stream of landed rows, each micro-batch
  de-duplicated by key (newest first) and merged into the bronze table
  (``foreachBatch``) keeping the newest row per key.
* R02 ``windowed_kpis``: event-time daily (or hourly) KPIs. The watermark is
  the latest time of all earlier micro-batches less the lookback length. Rows
  whose window ended by then are late: they go into a table of their own, the
  others are summed and added to the KPI table window by window.

Each table is written exactly once per micro-batch: the number of the last
batch of a stream is kept in the table's ledger and changes in the same commit
as its rows, so a batch that Spark replays after a crash between the table's
commit and the checkpoint's changes nothing. R02 keeps the watermark there
too; its late rows are committed before its windows, one folder per batch.

Both keep their progress in a checkpoint folder under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), so a restarted job
resumes where it stopped. A new checkpoint folder is a new stream.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.session import checkpoint_dir, materialize, release
from mkpulse.sinks import dedupe, ledger, path_exists, read_text, recover, upsert, write_partition


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when it made the checkpoint folder; a restarted stream keeps it."""
    return json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def landing_to_bronze(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    keys: Sequence[str],
    checkpoint: str,
    fmt: str = "parquet",
    glob: str | None = None,
    order_col: str = "extracted_at",
    tiebreak: Sequence[str] = (),
    partition_col: str | None = None,
    max_files_per_trigger: int | None = None,
    derive=None,
    distinct_within: tuple[str, str] | None = None,
):
    """Stream landed files into a keyed bronze table (availableNow: all
    files present now, in micro-batches, then stop). ``derive`` adds columns
    to each micro-batch (e.g. the date partition); with ``partition_col`` each
    micro-batch rewrites only the partitions it touches. With
    ``distinct_within=(time column, delay)`` a row that lands again under the
    same key and time within the delay is dropped from the stream's state
    before it reaches the table. Returns the query."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    if distinct_within:
        time, delay = distinct_within
        stream = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        me = stream_id(spark, checkpoint)
        recover(spark, target)
        if ledger(spark, target).get(me, -1) >= batch_id:
            return  # committed before the crash that made Spark replay it
        if derive is not None:
            batch = derive(batch)
        if order_col not in batch.columns:
            batch = batch.withColumn(order_col, F.lit(None).cast("timestamp"))
        clean = dedupe(batch, keys, order_col, tiebreak)
        upsert(clean, target, keys, partition_col=partition_col, newest_col=order_col, entry={me: batch_id})

    return (
        stream.writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _utc(events: DataFrame, ts: str) -> Column:
    """The event time as TIMESTAMP; a wall-clock value is read as UTC, whatever the session time zone."""
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        return F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(ts)


def windowed_kpi_frame(events: DataFrame, ts: str = "ts", window: str = "1 day", lateness: str = "3 days",
                       by: Sequence[str] = ("event_type",), value: str = "value") -> DataFrame:
    """R02 plan: event-time windows with a watermark (works on a stream or a
    batch frame)."""
    ntz = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    events = events.withColumn(ts, _utc(events, ts))  # watermarks need TIMESTAMP; windows align to UTC days

    def back(c: str):
        # window bounds back to wall-clock (UTC) values of the input's type
        if not ntz:
            return F.col(c)
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))

    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum"))
        .select(back("w.start").alias("window_start"), back("w.end").alias("window_end"), *by, "events", "value_sum")
    )


def split_late(events: DataFrame, ts: str, window: str, lateness: str, latest: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows on time, and the others with a ``reason``.

    ``latest`` is the greatest event time seen before (microseconds since
    1970, None at the start). A row is late if its window ended ``lateness``
    before that, or if it has no time at all.
    """
    cols = [F.col(f"`{c}`") for c in events.columns]
    marked = events.withColumn("_at", _utc(events, ts))
    timed = marked.where(F.col("_at").isNotNull()).withColumn("_w", F.window("_at", window))
    late = F.lit(False)
    if latest is not None:
        late = F.col("_w.end") <= F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {lateness}")
    none = marked.where(F.col("_at").isNull()).select(*cols, F.lit("no time").alias("reason"))
    return timed.where(~late).select(*cols), timed.where(late).select(*cols, F.lit("late").alias("reason")).unionByName(none)


def windowed_kpis(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    ts: str = "ts",
    window: str = "1 day",
    lateness: str = "3 days",
    by: Sequence[str] = ("event_type",),
    fmt: str = "parquet",
    glob: str | None = None,
    value: str = "value",
    late: str | None = None,
    max_files_per_trigger: int | None = None,
):
    """Windowed KPIs, each micro-batch added to the windows it touches.

    The table is partitioned by ``window_day``: a micro-batch rewrites the
    days of its windows only. Rows that come later than ``lateness`` go,
    whole, into the table at ``late`` (``<target>_late`` if not given), one
    folder per micro-batch; see :func:`late_rows`. Returns the query.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    keys = ["window_day", "window_start", "window_end", *by]
    late = late or late_path(target)

    def add(rows: DataFrame, batch: DataFrame) -> DataFrame:
        both = rows.unionByName(batch)
        return both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("events").alias("events"), F.sum("value_sum").alias("value_sum"))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        me = stream_id(spark, checkpoint)
        recover(spark, target)
        last = ledger(spark, target).get(me) or {"batch": -1, "latest": None}
        if last["batch"] >= batch_id:
            return  # committed before the crash that made Spark replay it
        others = split_late(batch, ts, window, lateness, last["latest"])[1]
        seen, placed = Observation("r02-seen"), Observation("r02-placed")
        observed = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros(_utc(batch, ts))).alias("latest"))
        kept = split_late(observed, ts, window, lateness, last["latest"])[0].observe(placed, F.count(F.lit(1)).alias("rows"))
        frame = windowed_kpi_frame(kept, ts, window, lateness, by, value).withColumn("window_day", F.to_date("window_start"))
        held = materialize(frame, "r02-batch")
        if seen.get["rows"] > placed.get["rows"]:  # the batch is read a second time only if some are late
            write_partition(others, late, "batch_id", batch_id)
        known = [x for x in (last["latest"], seen.get["latest"]) if x is not None]
        upsert(held, target, keys, partition_col="window_day", combine=add, entry={me: {"batch": batch_id, "latest": max(known, default=None)}})
        release(held)

    return (
        reader.load(source).writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_path(target: str) -> str:
    return target.rstrip("/") + "_late"


def late_rows(spark: SparkSession, target: str, schema: T.StructType, late: str | None = None) -> DataFrame:
    """All rows that R02 runs into ``target`` found late or without a time, with
    ``reason`` and the ``batch_id`` of the micro-batch that brought them."""
    path = late or late_path(target)
    known = T.StructType([*schema.fields, T.StructField("reason", T.StringType()), T.StructField("batch_id", T.LongType())])
    recover(spark, path)
    return spark.read.schema(known).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], known)
