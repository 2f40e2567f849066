"""Session construction and shared-folder helpers.

Lineage is cut only with reliable checkpoints or written tables under the folder the
cluster names in ``spark.checkpoint.dir``. That setting is read from the session; a
private temporary folder is created only when it is unset *and* the master is local
(tests, benches, the driver's smoke check).
"""

from __future__ import annotations

import os
import tempfile
import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long tables keep one row per key; a map built from JSON keeps the last key.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "evidence_spark",
    conf: dict | None = None,
) -> SparkSession:
    """Return a session with the settings the library is tuned for.

    On a cluster pass ``master=None`` and let the launcher decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small partitions anyway).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; the extra path then
    names nothing there and does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Uses ``spark.checkpoint.dir`` when set. Otherwise, only in local mode, creates a
    fresh private folder (as tests do). On a cluster without the setting it raises:
    a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running jobs that cut lineage"
            )
        configured = tempfile.mkdtemp(prefix="evidence-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{_uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (never ``localCheckpoint``).

    Used after non-deterministic steps (random ids, user judge calls) so that a task
    retry or a second action sees the same values.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

