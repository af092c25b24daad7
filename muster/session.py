"""Session construction and the shared checkpoint folder.

On a cluster the operator of the cluster names a shared folder in
``spark.checkpoint.dir``; we read it from the session. Only on a local master is a scratch
folder of our own set when it is unset; elsewhere that raises.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "muster") -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, total_cores: int, shuffle_fraction: float = 0.5,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for a cluster job that reads ``input_bytes`` on ``total_cores``.

    Shuffle partitions are sized so one reduce partition holds about
    ``target_partition_bytes`` of the expected shuffle volume (``shuffle_fraction`` of
    the pruned input), never fewer than two waves of tasks; AQE then coalesces small
    partitions and splits skewed ones (a key holding a third of the rows) at runtime.
    Broadcasts are left to AQE's runtime size check. ``spark.checkpoint.dir`` is the
    cluster's shared folder and is never set here.
    """
    shuffle_bytes = int(input_bytes * shuffle_fraction)
    partitions = max(2 * total_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Unset, a scratch folder is made for a local master (tests); on any other master that
    would be a folder the executors do not share, so it is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="muster-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, current)
        except Exception:  # a core config may be read-only at runtime; the context is enough
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where a later step depends on the physical layout of ``df`` (partition
    ids, per-partition positions) and a recomputation after a lost executor must
    see exactly the same layout.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
