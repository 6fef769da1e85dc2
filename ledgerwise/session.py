"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers are
for tests, ``bench.py`` and command-line use. Cluster deployments pass their own
session, and every operator reads what it needs (for example the checkpoint
folder) from that session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library should carry. They are plain Spark
# settings, so a cluster submit can set the same keys instead.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast by size, with the larger limit only where the size is measured: AQE
    # sees the real bytes of a finished shuffle stage (64 MB keeps dimension-sized
    # sides in memory while fact-sized sides shuffle). The plan-time threshold acts on
    # estimates (compressed file bytes, exact only for literal tables), so it stays at
    # Spark's 10 MB, where even a several-fold underestimate is a small broadcast.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                     shuffle_fraction: float = 0.25) -> dict:
    """Sizing settings for a cluster run over ``input_bytes`` of source data.

    * Scan splits of ``maxPartitionBytes`` (128 MB) keep one task's decoded
      batch well inside an executor core's share of memory.
    * The initial shuffle partition count targets ``target_partition_bytes``
      per partition for the widest shuffle, taken as ``shuffle_fraction`` of
      the input (scans are pruned to the needed columns and aggregates are
      partial before the exchange), rounded up to a multiple of the core count
      so the first wave fills the cluster; AQE then coalesces small partitions
      to the advisory size and splits skewed ones.
    * Sort-merge joins and sort aggregates spill when a partition outgrows
      memory, so these sizes bound spill rather than correctness.

    For 100 TiB on 1000 executors x 8 cores: 102,400 partitions of 256 MB,
    rounded up to 104,000 (13 full waves). Pass the result to ``SparkSession.builder.config`` or
    ``spark-submit --conf``; nothing here is applied implicitly.
    """
    parts = max(total_cores, -(-int(input_bytes * shuffle_fraction) // target_partition_bytes))
    parts = -(-parts // total_cores) * total_cores
    return {
        **{k: v for k, v in BASE_CONF.items() if not k.startswith("spark.ui")},
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        # Hot keys in plain aggregations are handled by partial aggregation; rebalance
        # partitions that AQE finds skewed before writes.
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }


def local_session(app: str = "ledgerwise", cores: str | int = "*", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("LEDGERWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    scratch = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ledgerwise-ckpt-")}
    for k, v in {**BASE_CONF, **scratch, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The run's own folder under the shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` is used as it is; where it is unset the folder lies under the
    session's warehouse, which executors share as well. The run's folder is deleted when the
    application ends.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        sc.setCheckpointDir(base)
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str = "tmp"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (the rows live in shared storage and
    survive lost executors) but computes the plan once; a reliable RDD
    checkpoint of an unpersisted plan computes it twice.
    """
    import uuid

    spark = df.sparkSession
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
