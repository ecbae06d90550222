"""Session construction and shared-storage settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tessera") -> SparkSession:
    """Return the active session or build a local one for tests and bench.

    On a cluster the session already exists (spark-submit); only the SQL
    settings that do not change results are applied there.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        # wide generated stages must still be JIT-compiled (the JVM skips methods > 8000 bytecodes)
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """SQL settings sized for an input of ``input_bytes`` on ``total_cores`` cores.

    Shuffle partitions: enough for about ``partition_bytes`` per partition when
    the whole input is shuffled once, at least 3 waves of tasks, at most 100k
    (AQE coalesces small ones at run time and splits skewed ones). File splits
    stay at 128 MB so a scan task fits comfortably in executor memory.
    Example: 100 TB on 8000 cores -> 409600 -> capped at 100000 partitions.
    """
    parts = max(3 * total_cores, -(-input_bytes // partition_bytes))
    parts = min(parts, 100_000)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the context's, else the cluster's
    ``spark.checkpoint.dir``. Where neither is set a scratch folder is made on a
    local master (tests, bench); a cluster, whose machines share no such folder,
    is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df):
    """Cut the lineage of a small, reused intermediate: an eager reliable
    checkpoint into the shared checkpoint folder (survives executor loss,
    unlike a local checkpoint), read back as a fresh scan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
