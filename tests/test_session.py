import pytest

import os

from mkpulse.session import BATCH_BYTES, SHUFFLE_CLEANUP, Tables, checkpoint_dir, materialize, release, scale_conf


def test_checkpoint_dir_reads_session_setting(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == before  # an existing setting is used as is
    assert spark.sparkContext.getCheckpointDir() is not None


def test_scale_conf_sizes_partitions():
    c = scale_conf(input_tb=100, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) >= 8000  # at least two tasks per core
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(input_tb=0.001, executors=2, cores_per_executor=2)
    assert int(small["spark.sql.shuffle.partitions"]) == 8


def test_tables_share_handles(spark):
    a = Tables(spark, "/root/testdata/sf0.001")
    assert a.lineitem is a["lineitem"]
    assert "l_orderkey" in a.lineitem.columns


def test_replaced_files_are_seen(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/t.parquet")
    assert Tables(spark, scratch).t.count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{scratch}/t.parquet")
    assert Tables(spark, scratch).t.count() == 5


def test_checkpoint_dir_must_be_set(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local-cluster[3,2,1000]"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_materialized_frames_leave_no_shuffle_and_can_be_released(spark):
    def shuffles():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")

    before, kept = shuffles(), spark.conf.get(SHUFFLE_CLEANUP)
    held = materialize(spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(4, "k"), "t-release")
    assert shuffles() <= before and spark.conf.get(SHUFFLE_CLEANUP) == kept
    path = held.materialized_at
    assert held.count() == 1000 and os.path.isdir(path)
    release(held, spark.range(3))
    assert not os.path.exists(path)
    release(held)  # a second time: nothing left to do


def test_batch_bytes_bound_the_arrow_batches_of_one_write(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) AS text").mapInArrow(sizes, "n long, size long")
    before = spark.conf.get(BATCH_BYTES)
    rows = materialize(texts, "sizes", "1m").collect()
    assert sum(r.n for r in rows) == 4000 and max(r.size for r in rows) < 1.2e6
    assert spark.conf.get(BATCH_BYTES) == before
    assert len(materialize(texts, "sizes").collect()) == 1
