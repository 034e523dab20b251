"""Session construction and cluster-provided settings.

Operators never build sessions themselves; they receive DataFrames. This module
is for entry points (bench, tests, notebooks) only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold for every job in this package. AQE re-plans joins and
# coalesces small shuffle partitions at runtime; skew-join splitting is on by
# default in Spark 4 but stated here so a cluster default cannot silently
# disable it.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # The page is off, but Spark keeps what it would show, the plan and metrics
    # of 1,000 executions, in the driver's heap: keep the last few only.
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "50",
    "spark.ui.retainedStages": "50",
    "spark.ui.retainedTasks": "1000",
    # Skip recording the Python call site of every DataFrame/Column call in the
    # JVM (error-message context only); it costs extra Py4J round trips per call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A long-lived session runs many different plans: keep more compiled
    # whole-stage code than the default 100 entries so it is not recompiled.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Let Spark's partial per-task limit apply to caps up to 100,000 rows.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Delete reliable-checkpoint files once their DataFrame is unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "ledgerlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.master.startswith("local")
                                                        and not spark.sparkContext.master.startswith("local-cluster")):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only for a local master
    without that setting (a test run) is a folder chosen here; a cluster must
    name shared storage, so anything else is an error.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder, different on every call."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
