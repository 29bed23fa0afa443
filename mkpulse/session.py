"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Spark's setting for deleting the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the most bytes in an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, partitions: int = 8, app: str = "mkpulse",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster pass ``conf=scale_conf(...)``
    (or use the caller's own session)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the executor; give it room
            b = b.config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 4,
               shuffle_fraction: float = 0.1, target_partition_mb: int = 256) -> dict[str, str]:
    """Session settings for a large cluster.

    Shuffle partitions are sized so the largest shuffle (about
    ``shuffle_fraction`` of the input once scans are pruned to the referenced
    columns and partially aggregated) lands at ~``target_partition_mb`` per
    partition, never below two tasks per core; AQE then coalesces small
    partitions and splits skewed ones at runtime. Scan splits of 512 MB keep
    the task count of a 100 TB scan near 200k (about 50 waves on 4000 cores).
    """
    cores = executors * cores_per_executor
    shuffle_bytes = input_tb * shuffle_fraction * 1024 ** 4
    parts = int(max(2 * cores, min(200_000, shuffle_bytes / (target_partition_mb * 1024 ** 2))))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set: a folder chosen here would be local to one
    machine, and what executors write there would be lost to the others. Only
    a session whose driver is its executor (``local[n]``, as in tests) gets a
    folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="mkpulse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, tag: str, batch_bytes: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: a
    frame that several branches of a plan read is computed once, and a lost
    executor does not recompute what is upstream of it. What the write shuffled
    is deleted when it is done: nothing reads it again.

    ``batch_bytes`` bounds the Arrow batches between the JVM and Python during
    the write: ten thousand rows, Spark's own bound, are much memory if they
    hold whole texts, and each task has them several times over."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    own = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: batch_bytes} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.schema(df.schema).parquet(path)
    held.materialized_at = path
    return held


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`materialize` wrote, once nothing
    will read them again. Other frames are left alone."""
    for frame in frames:
        path = frame.__dict__.pop("materialized_at", None)
        if path:
            spark = frame.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Lazy ``name -> DataFrame`` over one folder of parquet tables.

    Handles and the plans derived from them (``memo``) live as long as this
    object: one query reads one listing of the files, the next a new one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.handles: dict[str, DataFrame] = {}
        self.memo: dict[tuple, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.handles:
            self.handles[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.handles[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "root", "handles", "memo"):
            raise AttributeError(name)
        return self[name]
