"""Session helpers: a local session for tests/bench and lineage cutting.

On a cluster the caller owns the session; nothing here overrides settings
that are already present (in particular ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Sizes that bound what may be collected to the driver or broadcast.  They are
# plain module constants so that a deployment can tune them in one place.
MAX_LEVELS = 10_000            # categorical levels allowed in a dictionary / wide output
BROADCAST_ROWS = 200_000       # rows of a small side that may be broadcast


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "loom") -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on, ANSI left on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is respected as is
    (unset on a cluster is an error).  Only in local mode (tests, the bench) an
    unset setting is filled with a fresh scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder on shared storage; "
                         "checkpoints must survive the loss of an executor")
    path = tempfile.mkdtemp(prefix="loom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
