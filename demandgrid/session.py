"""Session defaults.  Nothing here overrides what a cluster already sets."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    """Session for tests and the local bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("demandgrid")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # call-site capture per column operation only helps error messages
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.ui.retainedExecutions", "5")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def many(spark: SparkSession) -> int:
    """Partitions for work that is heavy beside its bytes, which adaptive coalescing would
    put into few tasks: an explicit number is kept."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: the one the cluster names.  Only a
    local[*] session may fall back on a scratch folder of its own; elsewhere each
    machine would write to its own disk, so the setting is required."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="demandgrid-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the folder of shared_dir()."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = shared_dir(spark)
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(folder)
