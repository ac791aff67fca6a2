"""Spark session defaults and the shared checkpoint folder.

The library never creates a session behind the user's back when one is
running: ``get_spark`` reuses the active session and only fills in settings
that matter for correctness (UTC, AQE).  A master is set only where none is
configured (not under ``spark-submit``).  The checkpoint folder is taken from
``spark.checkpoint.dir`` on the session (the cluster's shared folder); a
temporary folder is used only by a local session that names none, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def _submitted() -> bool:
    """Started by spark-submit, which brings its own master."""
    return "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def get_spark(master: str | None = None, partitions: int | None = None, app: str = "scriptorium") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("SCRIPTORIUM_MASTER") or (None if _submitted() else "local[*]")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "16g"))
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, configuring the context if needed.

    Order: a folder already set on the context, then the session setting
    ``spark.checkpoint.dir`` (the shared folder a cluster names).  Where both
    are missing, a local session gets a fresh temporary folder; a cluster
    session raises, since its executors do not share one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where re-evaluating the plan could change the result (range
    partitioning samples its bounds) or where a loop would grow the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch that goes to the Python of a task (Spark's setting counts rows first, and a row can be a whole text).
BATCH_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession | None = None) -> None:
    """Keep the memory of Python tasks apart from the input's size: batches of ``BATCH_BYTES``, unless the session asks for a size itself."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
