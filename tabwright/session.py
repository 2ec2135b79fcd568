"""Session construction and the few session-level settings the engine relies on."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session built here carries.  AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splits a hot key's partition.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",     # a checkpoint goes with the last frame that reads it
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tabwright", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one (local mode when ``master`` is given)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS/S3/ABFS) folder and is read
    as given.  Only when it is unset — local tests — a scratch folder is made.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tabwright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what superseded frames hold on disk, between the turns of an iteration.

    Spark's cleaner removes the shuffle files and checkpoints of frames that nothing refers to any more, but only
    learns of them when Python and the driver's JVM collect garbage, which a short loop seldom makes them do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
