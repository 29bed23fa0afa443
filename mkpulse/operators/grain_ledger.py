"""Grain checks that read changed partitions only (Q01-Q05, incremental).

The ledger of a table keeps, per partition of the table, one row for each
distinct key: a 128-bit fingerprint, how many rows have it, and which of its
columns are NULL. Fingerprints merge by adding counts, so a key that lies in
several partitions is found as well. After an upsert only the partitions whose
files changed are read again; the check itself runs over the narrow ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mkpulse.sinks import ledger, partition_stamps, partition_values, recover, replace_partitions

#: Partition column of the ledger: a name for the table's partition that needs no escaping in a path.
PART = "part"


def fingerprint(keys: Sequence[str]) -> list[Column]:
    """Two independent hashes of a key tuple; NULL is a value of its own."""
    each = [x for k in keys for x in (F.col(k), F.col(k).isNull())]
    return [F.xxhash64(F.lit(salt), *each).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def _part(value: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null")))


def refresh_grain_ledger(spark: SparkSession, table: str, path: str, keys: Sequence[str], column: str) -> list[str]:
    """Bring the ledger at ``path`` up to date with ``table``, partitioned by ``column``; returns the partition folders read.

    Another key, or a partition column whose type changed, reads everything."""
    recover(spark, table)
    recover(spark, path)
    schema = spark.read.parquet(table).schema
    about = {"keys": list(keys), "type": schema[column].dataType.simpleString()}
    now, then = partition_stamps(spark, table), ledger(spark, path)
    old = then.get("stamps", {}) if all(then.get(k) == v for k, v in about.items()) else {}
    changed = sorted(f for f in now if now[f] != old.get(f))
    dropped = {f for f in then.get("stamps", {}) if f not in now or not old}
    if not changed and not dropped:
        return []
    values = partition_values(spark, sorted(dropped | set(changed)), schema[column].dataType)
    names = {f: "=" + str(v) if v is not None else "null" for f, v in values.items()}
    folders = {f"{PART}={hashlib.md5(n.encode()).hexdigest()}" for n in names.values()}
    if changed:
        rows = spark.read.schema(schema).option("basePath", table).parquet(*[f"{table.rstrip('/')}/{f}" for f in changed])
    else:
        rows = spark.createDataFrame([], schema)
    nulls = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]))
    prints = rows.groupBy(_part(F.col(column)).alias(PART), *fingerprint(keys), F.array_join(nulls, ",").alias("nulls")).agg(
        F.count(F.lit(1)).alias("n"))
    replace_partitions(prints, path, PART, sorted(folders), about | {"stamps": now})
    return changed


def grain_report(spark: SparkSession, path: str, table: str = "") -> DataFrame:
    """Q04's row for the table, and the number of duplicate keys (Q01), from its ledger."""
    keys = ledger(spark, path)["keys"]
    per_key = spark.read.parquet(path).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("nulls").alias("nulls"))
    held = F.array_compact(F.array(*[F.when(F.max(F.array_contains(F.split("nulls", ","), k).cast("int")) == 1, F.lit(k)) for k in keys]))
    g = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"), held.alias("_nulls"))
    return g.select(F.lit(table).alias("table"), "row_count", (F.col("duplicate_rows") == 0).alias("grain_ok"), "duplicate_groups", "duplicate_rows",
                    F.array_join("_nulls", ",").alias("null_key_columns"))

