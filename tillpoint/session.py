"""SparkSession construction and the shared staging folder.

Staged tables and reliable checkpoints go to the folder the cluster names in
``spark.checkpoint.dir``. Only when that is unset (local tests) do we create
one of our own.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.maxMetadataStringLength": "1000",  # a plan's text names all filters of a scan (100: cut in long sessions)
}


def build_session(master: str = "local[8]", app: str = "tillpoint",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the library's settings. The number of shuffle partitions is left
    to the cluster's own setting unless given."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if _context(spark) is not None:
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", "app")


def _local_folder(spark: SparkSession) -> str:
    """A machine-local folder, allowed only for sessions that are known to run in one
    process (tests); it is removed when the driver ends."""
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: staged tables and reliable "
                           "checkpoints must survive the loss of an executor")
    folder = tempfile.mkdtemp(prefix="tillpoint-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``), creating
    a local one only when none is configured and the session is local (tests)."""
    sc = _context(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc is None:
        if configured:
            return configured
        local = _local_folder(spark)
        spark.conf.set("spark.checkpoint.dir", local)
        return local
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    sc.setCheckpointDir(_local_folder(spark))
    return sc.getCheckpointDir()


def staging_root(spark: SparkSession) -> str:
    """Folder for staged (written) tables: a sibling of the checkpoint folder's
    per-application subfolder, so it lives on the same shared file system."""
    ckpt = ensure_checkpoint_dir(spark)
    return os.path.join(ckpt.rstrip("/"), "tillpoint-stage")


def clean_staging(spark: SparkSession) -> bool:
    """Remove this session's staged tables, published outputs and scratch folders below
    the shared checkpoint folder. Call it when the session's results are no longer read
    (frames over staged tables cannot be read afterwards). Local folders go at exit."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
