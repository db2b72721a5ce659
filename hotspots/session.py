"""Session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; every lineage cut
and every scratch table lives below it. Only on a local master (unit tests,
local runs) with nothing configured do we pick a folder of our own; on a
cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from hotspots.sources.paths import make_folder

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
    # post-shuffle partitions are coalesced / split towards this size at run time
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
}


def sizing(input_bytes: int, executor_cores: int, target_bytes: int = 128 << 20) -> dict:
    """Shuffle and scan sizing for a run over ``input_bytes`` of input.

    Start with enough shuffle partitions that each holds about ``target_bytes``
    (AQE merges the small ones), never fewer than two waves of the cluster's
    cores; split files into scan tasks of the same size.
    """
    parts = max(2 * executor_cores, -(-input_bytes // target_bytes))
    return {"spark.sql.shuffle.partitions": str(parts),
            "spark.sql.files.maxPartitionBytes": str(target_bytes)}


def apply_sizing(spark: SparkSession, input_bytes: int, executor_cores: int) -> None:
    for k, v in sizing(input_bytes, executor_cores).items():
        spark.conf.set(k, v)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hotspots") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; on a local master a temporary one is
    set where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="hotspots-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    make_folder(spark, path)
    return path
