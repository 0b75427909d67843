"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "sparselm",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one with sane defaults.

    On a cluster the session is normally created by the launcher and this
    simply returns it; the options below matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # iterative fits run hundreds of small jobs: keep driver-side
         # bookkeeping of finished jobs/queries short
         .config("spark.sql.ui.retainedExecutions", "50")
         .config("spark.ui.retainedJobs", "200")
         .config("spark.ui.retainedStages", "200")
         .config("spark.driver.memory", os.environ.get("SPARSELM_DRIVER_MEMORY", "8g")))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local runs, tests) a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise ValueError("set spark.checkpoint.dir to a shared folder "
                             "(e.g. on the cluster's distributed file system)")
        d = tempfile.mkdtemp(prefix="sparselm-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark)
    import uuid
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written(spark: SparkSession, df, name: str):
    """``(table, path)``: ``df`` written once below the checkpoint folder and
    read back, so that every later reader sees the rows of one execution."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df):
    """``(frame, path)``: a reliable checkpoint and the folder that holds it,
    for :func:`delete_path` once it is superseded."""
    out = df.checkpoint(eager=True)
    kept = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return out, kept.get() if kept.isDefined() else None


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`written`, on whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# rows up to which a side with a known row count is hinted for broadcast
BROADCAST_MAX_ROWS = 1_000_000


def bounded_broadcast(df, rows: int, max_rows: int | None = None):
    """Broadcast hint for a side whose row count is known (a dictionary of p
    names, per-partition offsets), only while it stays under the limit;
    beyond it the planner (and AQE, from measured sizes) picks the join."""
    from pyspark.sql import functions as F

    limit = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    return F.broadcast(df) if rows <= limit else df
