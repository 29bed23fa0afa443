"""Write operators K01-K08: replace, keyed upsert, dedupe, stamping, audit.

Tables are Parquet folders. A write never overwrites the folder it reads:
new content is written to a swap folder beside the table
(``<table>.swap-<id>/new``). When it is whole, a ``COMMIT`` file there names
the folders to exchange and says of each whether the table had it before and
whether the new content has it; only then are folders renamed, old ones into
``<table>.swap-<id>/old``. With all in place ``COMMIT`` becomes ``DONE`` and
the swap folder is deleted. Nothing but data ever lies inside the table
folder. ``recover`` carries a committed swap to its end (a folder the write
made is never taken away again, however often it is repeated) and drops the
others; every write does so first.

One writer at a time: a write holds ``<table>.lease``, a file that names it
and that it renews while it lives. A second writer gets :class:`TableBusy`. A
lease not renewed for ``LEASE_S`` seconds is broken; its writer finds so
before it commits, or before the next folder it moves, and stops. Where the
file system creates files atomically (HDFS) the lease is exact.

A stream's progress can be committed with a table: the ``ledger`` given to a
write is kept in ``<table>.ledger`` and changes in the same commit.

A table partitioned by a column is upserted partition by partition: only the
partitions that hold the batch's rows or keys are read, merged and exchanged.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.operators.joins import anti_by_keys, semi_by_keys
from mkpulse.operators.windows import keep_latest
from mkpulse.session import materialize, release


# ----------------------------------------------------------------- frame level
def upsert_frame(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """K02 / K03 plan: target rows whose key is not in the batch, plus the whole
    batch. Duplicates inside the batch survive (as in the reference); run
    :func:`dedupe` on the batch first to make the load idempotent."""
    missing = [k for k in keys if k not in batch.columns or k not in target.columns]
    if not keys or missing:
        raise ValueError(f"upsert needs key columns present on both sides; missing {missing or 'all'}")
    return anti_by_keys(target, batch, keys, null_safe).unionByName(batch, allowMissingColumns=True)


def merge_newest(target: DataFrame, batch: DataFrame, keys: Sequence[str], order_col: str = "extracted_at") -> DataFrame:
    """Upsert variant for out-of-order arrival: per key the row with the newest
    ``order_col`` survives, whether it is already in the table or in the batch
    (the batch wins ties). Replaying any batch, in any order, gives the same
    table."""
    u = target.withColumn("_from_batch", F.lit(0)).unionByName(batch.withColumn("_from_batch", F.lit(1)), allowMissingColumns=True)
    return keep_latest(u, keys, order_col, ["_from_batch"]).drop("_from_batch")


def dedupe(df: DataFrame, keys: Sequence[str], order_col: str = "extracted_at", tiebreak: Sequence[str] = ()) -> DataFrame:
    """K05 plan: newest ``order_col`` per key (NULLs last)."""
    return keep_latest(df, keys, order_col, tiebreak)


def dedupe_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K05 / Q05 numbers: rows, distinct key tuples (a NULL inside a tuple is
    a value), duplicates to delete."""
    g = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(F.struct(*keys)).alias("unique_keys"))
    return g.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_keys"))


def stamp(df: DataFrame, ts: dt.datetime | None = None, name: str = "extracted_at") -> DataFrame:
    """Constant extraction time for the whole batch."""
    ts = ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return df.withColumn(name, F.lit(ts).cast("timestamp"))


def typed_replace_batch(df: DataFrame, keys: Sequence[str], renames: dict[str, str] | None = None,
                        date_cols: Sequence[str] = (), numeric_cols: Sequence[str] = ()) -> DataFrame:
    """K04 batch shaping: camel -> snake renames, 'yyyyMMdd' -> DATE, '' -> 0,
    then last row per key wins (INSERT OR REPLACE order = landing order, kept
    by a monotonically increasing id)."""
    from mkpulse.functions import safe_float, to_day

    out = df.withColumn("_ord", F.monotonically_increasing_id())
    for a, b in (renames or {}).items():
        out = out.withColumnRenamed(a, b)
    for c in date_cols:
        out = out.withColumn(c, to_day(c))
    for c in numeric_cols:
        out = out.withColumn(c, safe_float(c, 0.0))
    return keep_latest(out, keys, "_ord").drop("_ord")


# ----------------------------------------------------------------- path level
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if there is none."""
    fs, p, _ = _fs(spark, path)
    return _read(fs, p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that is no table."""
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def _children(fs, folder) -> list:
    return [st.getPath() for st in fs.listStatus(folder)] if fs.exists(folder) else []


def _swaps(spark: SparkSession, path: str, mark: str) -> list:
    fs, p, _ = _fs(spark, path.rstrip("/"))
    parent = p.getParent()
    return [c for c in _children(fs, parent) if c.getName().startswith(p.getName() + mark)] if parent is not None else []


#: Seconds after which a lease that was not renewed counts as left by a dead writer.
LEASE_S = 900
#: The same for a lease file without a name in it: its writer died between making and filling it.
HALF_MADE_S = 30
#: Leases that writes of this process hold: lease file -> writer.
_held: dict[str, str] = {}


class TableBusy(RuntimeError):
    """Another writer holds the table, or took it over."""


def _read(fs, p) -> str | None:
    if not fs.exists(p):
        return None
    src = fs.open(p)
    try:
        return bytes(src.readAllBytes()).decode()
    finally:
        src.close()


def _write(fs, p, text: str, overwrite: bool) -> None:
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class Lease:
    """The right to write the table at ``path``, renewed by a thread of its own until released."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs, p, jvm = _fs(spark, path.rstrip("/") + ".lease")
        self.file, self.key, self.me = p, p.toString(), f"{spark.sparkContext.applicationId} {uuid.uuid4().hex}"
        self.path, self.app = path, spark.sparkContext.applicationId
        self.over = threading.Event()

    def take(self) -> None:
        held = _read(self.fs, self.file)
        if held is not None:
            # of this application but of no living write: its write failed and could not release it
            orphan = held.split(" ")[0] == self.app and _held.get(self.key) != held
            age = time.time() - self.fs.getFileStatus(self.file).getModificationTime() / 1000
            if not orphan and age < (LEASE_S if held else HALF_MADE_S):
                raise TableBusy(f"{self.path} is being written by {held or 'someone'} (lease renewed {age:.0f} s ago)")
            self.fs.delete(self.file, False)
        self.fs.mkdirs(self.file.getParent())
        try:
            _write(self.fs, self.file, self.me, overwrite=False)
        except Exception as e:  # noqa: BLE001 - the file system's own kind: someone was faster
            raise TableBusy(f"{self.path}: the lease could not be made") from e
        _held[self.key] = self.me
        threading.Thread(target=self._renew, daemon=True).start()

    def _renew(self) -> None:
        while not self.over.wait(LEASE_S / 4):
            with contextlib.suppress(Exception):  # a lease that cannot be renewed runs out, and the write finds it lost
                if _read(self.fs, self.file) == self.me:
                    _write(self.fs, self.file, self.me, overwrite=True)

    def check(self) -> None:
        if _read(self.fs, self.file) != self.me:
            raise TableBusy(f"{self.path}: another writer took the table over")

    def release(self) -> None:
        self.over.set()
        if _held.get(self.key) == self.me:
            del _held[self.key]
        if _read(self.fs, self.file) == self.me:
            self.fs.delete(self.file, False)


@contextlib.contextmanager
def writing(spark: SparkSession, path: str) -> Iterator[Lease]:
    """Hold the table's lease; what earlier writers left is finished or dropped first."""
    lease = Lease(spark, path)
    lease.take()
    try:
        _recover(spark, path, lease)
        yield lease
    finally:
        lease.release()


def recover(spark: SparkSession, path: str) -> bool:
    """Finish an interrupted write of the table at ``path``; True when the table changed.

    A swap folder with ``COMMIT`` is carried on to its end, one without is
    dropped: the table was not touched yet, or has all of it (``DONE``).
    Several committed swaps, or a missing table with several ``.old-*``
    folders, raise: nothing says which of them is the table. While another
    write is alive it raises :class:`TableBusy`.
    """
    lease = Lease(spark, path)
    lease.take()
    try:
        return _recover(spark, path, lease)
    finally:
        lease.release()


def _recover(spark: SparkSession, path: str, lease: Lease) -> bool:
    fs, p, jvm = _fs(spark, path.rstrip("/"))
    swaps = _swaps(spark, path, ".swap-")
    done = [s for s in swaps if fs.exists(jvm.org.apache.hadoop.fs.Path(s, "COMMIT"))]
    if len(done) > 1:
        raise RuntimeError(f"{path}: several committed swaps: {', '.join(s.getName() for s in done)}")
    for s in swaps:
        if s in done:
            _finish(spark, s.toString(), path, lease)
        else:
            fs.delete(s, True)
    if done or fs.exists(p):
        return bool(done)
    olds = _swaps(spark, path, ".old-")
    if len(olds) > 1:
        raise RuntimeError(f"{path} is missing and several copies exist: {', '.join(o.getName() for o in olds)}")
    return bool(olds and fs.rename(olds[0], p))


def ledger(spark: SparkSession, path: str) -> dict:
    """What writes of the table at ``path`` committed beside its rows (see :func:`upsert`); call under its lease or after :func:`recover`."""
    fs, p, _ = _fs(spark, path.rstrip("/") + ".ledger")
    return json.loads(_read(fs, p) or "{}")


def _commit(spark: SparkSession, swap: str, path: str, folders: Sequence[str], lease: Lease, entry: dict | None = None,
            exchange: bool = True) -> None:
    """Name the folders to exchange (``""``: the whole table) and exchange them.

    A named folder that the new content lacks is removed from the table.
    """
    fs, p, jvm = _fs(spark, swap)
    hp = jvm.org.apache.hadoop.fs.Path
    plan = [[f, bool(fs.exists(_in(hp, path, f))), bool(fs.exists(_in(hp, f"{swap}/new", f)))] for f in folders]
    _write(fs, hp(p, "COMMIT.part"), json.dumps({"folders": plan, "ledger": ledger(spark, path) | entry if entry else None}), overwrite=True)
    lease.check()
    if not fs.rename(hp(p, "COMMIT.part"), hp(p, "COMMIT")):  # the mark is there whole or not at all
        raise OSError(f"could not commit {swap}")
    if exchange:
        _finish(spark, swap, path, lease)


def _in(hp, folder: str, name: str):
    return hp(folder.rstrip("/") + ("/" + name if name else ""))


def _finish(spark: SparkSession, swap: str, path: str, lease: Lease) -> None:
    """Exchange the folders of a committed swap; may be repeated from any point."""
    fs, p, jvm = _fs(spark, swap)
    hp = jvm.org.apache.hadoop.fs.Path
    commit = json.loads(_read(fs, hp(p, "COMMIT")))

    def move(a, b):
        lease.check()
        fs.mkdirs(b.getParent())
        if fs.exists(b) or not fs.rename(a, b):
            raise OSError(f"could not move {a} to {b}")

    for name, was, comes in commit["folders"]:
        final, new, old = _in(hp, path, name), _in(hp, f"{swap}/new", name), hp(p, "old/" + (name or "table"))
        if was and not fs.exists(old):
            move(final, old)
        if comes and fs.exists(new):  # else it is in the table already
            move(new, final)
    if commit["ledger"]:
        _write(fs, hp(path.rstrip("/") + ".ledger"), json.dumps(commit["ledger"]), overwrite=True)
    # from here on nothing may be repeated: what lies in old goes, in any order
    if not fs.rename(hp(p, "COMMIT"), hp(p, "DONE")):
        raise OSError(f"could not close {swap}")
    fs.delete(p, True)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns by whose values the folders of the table at ``path`` are named."""
    fs, p, _ = _fs(spark, path)
    found: list[str] = []
    while True:
        named = [c for c in _children(fs, p) if "=" in c.getName() and fs.getFileStatus(c).isDirectory()]
        if not named:
            return found
        found.append(named[0].getName().split("=", 1)[0])
        p = named[0]


def _new_swap(path: str) -> str:
    return f"{path.rstrip('/')}.swap-{uuid.uuid4().hex[:8]}"


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = (), entry: dict | None = None) -> int:
    """Full replace. Empty input is a no-op that succeeds (returns 0). ``df`` is
    evaluated once. ``entry`` goes into the table's ledger in the same commit."""
    with writing(df.sparkSession, path) as lease:
        return _replace(df, path, partition_by, lease, entry)


def _replace(df: DataFrame, path: str, partition_by: Sequence[str], lease: Lease, entry: dict | None = None) -> int:
    spark = df.sparkSession
    obs, swap = Observation("k01"), _new_swap(path)
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(swap + "/new")
    n = int(obs.get["rows"])
    if n or entry:
        _commit(spark, swap, path, [""] if n else [], lease, entry)
    else:
        fs, p, _ = _fs(spark, swap)
        fs.delete(p, True)
    return n


def write_partition(df: DataFrame, path: str, column: str, value: object) -> int:
    """Put the rows of ``df`` into the folder ``column=value`` of the table at ``path``,
    in place of what it held; other folders stay. Returns the rows written."""
    spark = df.sparkSession
    with writing(spark, path) as lease:
        if path_exists(spark, path) and (has := partition_columns(spark, path)) != [column]:
            raise ValueError(f"{path} is partitioned by {has or 'nothing'}, not by {column}")
        obs, swap = Observation("part"), _new_swap(path)
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(f"{swap}/new/{column}={value}")
        _commit(spark, swap, path, [f"{column}={value}"], lease)
        return int(obs.get["rows"])


#: The folder of a NULL partition value, as Spark names it.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def partition_stamps(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition folder -> stamp of its files (names and sizes), for a table partitioned by one column.

    Every write gives files new names, so a folder whose stamp is unchanged
    holds the rows it held. Reads listings only, one per folder."""
    fs, p, _ = _fs(spark, path.rstrip("/"))
    out = {}
    for folder in _children(fs, p):
        if "=" in folder.getName():
            files = sorted(f"{st.getPath().getName()}:{st.getLen()}" for st in fs.listStatus(folder) if not st.getPath().getName().startswith(("_", ".")))
            out[folder.getName()] = hashlib.sha1("\n".join(files).encode()).hexdigest()
    return out


def partition_values(spark: SparkSession, folders: Sequence[str], kind: T.DataType) -> dict[str, object]:
    """Partition folder -> its value in the column's type."""
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    raw = [(f, None if (v := f.split("=", 1)[1]) == NULL_FOLDER else unescape(v)) for f in folders]
    return {r.f: r.v for r in spark.createDataFrame(raw, "f string, v string").select("f", F.col("v").cast(kind).alias("v")).collect()}


def replace_partitions(df: DataFrame, path: str, column: str, folders: Sequence[str], entry: dict | None = None) -> int:
    """Put the rows of ``df`` in place of the table's partitions ``folders``; one that
    ``df`` has no row for is emptied. ``df`` must hold rows of these partitions
    alone. Other partitions are not read. Returns the rows written."""
    spark = df.sparkSession
    with writing(spark, path) as lease:
        if path_exists(spark, path) and (has := partition_columns(spark, path)) not in ([], [column]):
            raise ValueError(f"{path} is partitioned by {has}, not by {column}")
        obs, swap = Observation("parts"), _new_swap(path)
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.partitionBy(column).parquet(swap + "/new")
        fs, p, _ = _fs(spark, swap + "/new")
        new = {c.getName() for c in _children(fs, p) if "=" in c.getName()}
        if more := new - set(folders):
            raise ValueError(f"rows of partitions that were not to be replaced: {', '.join(sorted(more)[:5])}")
        _commit(spark, swap, path, sorted(folders), lease, entry)
        return int(obs.get["rows"])


def _in_values(column: str, values: list):
    """``column`` is one of ``values``, NULL included; a plain predicate, so partitions are pruned."""
    c = F.col(column)
    cond = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    return cond | c.isNull() if None in values else cond


def upsert(batch: DataFrame, path: str, keys: Sequence[str], null_safe: bool = True,
           partition_col: str | None = None, schema: T.StructType | None = None, newest_col: str | None = None,
           combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, entry: dict | None = None, exchange: bool = True) -> dict:
    """Keyed upsert of ``batch`` into the table at ``path``.

    Missing table -> created from the batch. With ``partition_col`` only the
    partitions that the batch's rows belong to are rewritten and, if the key
    does not contain it, those that hold the batch's keys now; NULL is a
    partition like any other. A table whose folders are named by other columns
    is refused. With ``newest_col`` the newest row per key wins instead of the
    batch (see :func:`merge_newest`); ``combine(rows in scope, batch)`` merges
    in any other way. ``entry`` is added to the table's ledger in the same
    commit. With ``exchange=False`` an existing table is left as it is once the
    write is committed: the next writer or :func:`recover` moves the folders.
    The batch is evaluated once. Returns an audit dict.
    """
    with writing(batch.sparkSession, path) as lease:
        return _upsert(batch, path, keys, null_safe, partition_col, schema, newest_col, combine, entry, lease, exchange)


def _upsert(batch, path, keys, null_safe, partition_col, schema, newest_col, combine, entry, lease, exchange) -> dict:
    spark = batch.sparkSession
    by = [partition_col] if partition_col else []
    if not path_exists(spark, path):
        return {"mode": "create", "rows_written": _replace(batch, path, by, lease, entry)}
    if (has := partition_columns(spark, path)) != by:
        raise ValueError(f"{path} is partitioned by {has or 'nothing'}, not by {by or 'nothing'}")
    swap = _new_swap(path)
    batch.write.parquet(swap + "/batch")
    batch = spark.read.schema(batch.schema).parquet(swap + "/batch")
    known = schema or spark.read.parquet(path).schema
    if partition_col:  # folder names are read with the batch's type
        known = T.StructType([batch.schema[f.name] if f.name == partition_col else f for f in known.fields])
    target = spark.read.schema(known).parquet(path)
    scope, values = target, []
    if partition_col:
        values = [r[0] for r in batch.select(partition_col).distinct().collect()]
        if partition_col not in keys:
            held = semi_by_keys(target, batch, keys, null_safe).select(partition_col).distinct().collect()
            values = list(dict.fromkeys([*values, *(r[0] for r in held)]))
        scope = target.where(_in_values(partition_col, values))
    obs = Observation("k02")
    if combine:
        merged = combine(scope, batch)
    else:
        merged = merge_newest(scope, batch, keys, newest_col) if newest_col else upsert_frame(scope, batch, keys, null_safe)
    w = merged.observe(obs, F.count(F.lit(1)).alias("rows")).write
    (w.partitionBy(partition_col) if partition_col else w).parquet(swap + "/new")
    names = _folder_names(spark, scope, swap, partition_col) if partition_col else [""]
    _commit(spark, swap, path, names, lease, entry, exchange)
    return {"mode": "upsert", "rows_written": int(obs.get["rows"])}


def _folder_names(spark: SparkSession, scope: DataFrame, swap: str, partition_col: str) -> list[str]:
    """The partition folders that the new content has, or that hold rows in scope now."""
    fs, p, _ = _fs(spark, swap + "/new")
    new = {c.getName() for c in _children(fs, p)}
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    held = {unquote(r[0]) for r in scope.select(folder.alias("f")).distinct().collect()}
    return sorted(n for n in new | held if n.startswith(partition_col + "="))


def _surplus(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(_file, _at) of the rows that are not their key's newest, found over keys, order and places alone.

    Rows equal in ``order`` are decided by place: the last written one stays.
    """
    meta = {"_file": "file_path", "_at": "row_index", "_written": "file_modification_time"}
    narrow = df.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in order], *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()])
    newest = F.max(F.struct(*[F.col(f"_o_{c}") for c in order], "_written", "_file", "_at")).alias("_n")
    best = narrow.groupBy(*keys).agg(newest, F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_n._file").alias("_bf"), F.col("_n._at").alias("_ba"))
    same = (F.col("_file") == F.col("_bf")) & (F.col("_at") == F.col("_ba"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return narrow.join(best, match).where(~same).select("_file", "_at")


def dedupe_in_place(spark: SparkSession, path: str, keys: Sequence[str], order_col: str = "extracted_at",
                    tiebreak: Sequence[str] = ()) -> dict:
    """Keep the newest row per key in the table at ``path``; report rows
    before, unique keys, duplicates and rows deleted. Without the order
    column the last written row is kept. The table keeps its partition
    folders, and only those that hold surplus rows are read whole and written
    again: the surplus is found from keys, order and row places, and taken out
    of the wide rows by their places, so these are neither sorted nor, while
    the surplus is small, exchanged."""
    with writing(spark, path) as lease:
        df = spark.read.parquet(path)
        order = [c for c in (order_col, *tiebreak) if c in df.columns]
        surplus = materialize(_surplus(df, keys, order), "surplus")
        total, extra = df.count(), surplus.count()
        if extra:
            by = partition_columns(spark, path)
            swap, rows, names = _new_swap(path), df, [""]
            if by:
                found = surplus.select(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)).distinct().collect() if len(by) == 1 else []
                names = sorted({unquote(r[0]) for r in found}) or [""]
                if names != [""]:
                    rows = spark.read.schema(df.schema).option("basePath", path).parquet(*[f"{path.rstrip('/')}/{n}" for n in names])
            gone = surplus.select(F.col("_file").alias("_sf"), F.col("_at").alias("_sa"))
            kept = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
            kept = kept.join(gone, (F.col("_file") == F.col("_sf")) & (F.col("_at") == F.col("_sa")), "left_anti").drop("_file", "_at")
            w = kept.write
            (w.partitionBy(*by) if by else w).parquet(swap + "/new")
            _commit(spark, swap, path, names, lease)
        release(surplus)
    return {"total_rows": total, "unique_keys": total - extra, "duplicate_rows": extra, "deleted": extra}


def load(batch: DataFrame, path: str, keys: Sequence[str], lifetime: bool, partition_col: str | None = None) -> dict:
    """Lifetime loads replace, incremental loads upsert."""
    if lifetime:
        return {"mode": "replace", "rows_written": replace(batch, path, [partition_col] if partition_col else [])}
    return upsert(batch, path, keys, partition_col=partition_col)


def run_loads(loads: dict[str, Callable[[], dict]]) -> dict[str, dict]:
    """Run each dataset's load in turn. A failed one is recorded with its
    error and the run goes on; every result carries its ``duration_s``."""
    results: dict[str, dict] = {}
    for name, fn in loads.items():
        began = time.monotonic()
        try:
            got = dict(fn())
        except Exception as e:  # noqa: BLE001 - the audit row holds it
            got = {"error": f"{type(e).__name__}: {e}"}
        results[name] = got | {"duration_s": time.monotonic() - began}
    return results


def audit_rows(spark: SparkSession, results: dict[str, dict], run_ts: dt.datetime | None = None) -> DataFrame:
    """One audit row per dataset (rows, mode, error, duration) for a run; the
    caller appends it to an audit table."""
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [
        (name, r.get("mode"), int(r.get("rows_written") or 0), r.get("error"), r.get("duration_s"), run_ts)
        for name, r in sorted(results.items())
    ]
    schema = "dataset string, mode string, rows_written long, error string, duration_s double, run_ts timestamp"
    return spark.createDataFrame(rows, schema)


def run_totals(audit: DataFrame) -> DataFrame:
    """Per run: datasets, failures, rows written and seconds."""
    return audit.groupBy("run_ts").agg(
        F.count(F.lit(1)).alias("datasets"), F.count("error").alias("failed"), F.sum("rows_written").alias("rows_written"),
        F.sum("duration_s").alias("duration_s"))


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None,
                   mode: str = "overwrite") -> None:
    """Write ``df`` as a catalog table bucketed and sorted by ``keys``. Facts
    that are joined repeatedly on the same key (campaign, account) and are
    written with the same bucket count join without a shuffle of either side.
    ``path`` places the files (an external table) instead of the warehouse."""
    w = df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(table)
