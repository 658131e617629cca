"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Temporary folders of local sessions, by application.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Adaptive execution coalesces small shuffles and splits skewed joins, so the
    shuffle partition count is only an upper bound and stays a cluster setting.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Tables dealt out by file meet on file and date without another shuffle.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # Recording the Python call site of every column makes building plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Zone-less timestamps are turned into epoch micros in the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary folder:
    one for the whole session, removed when the program ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    run = spark.sparkContext.applicationId
    if run not in _LOCAL_DIRS:
        _LOCAL_DIRS[run] = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[run], ignore_errors=True)
    return _LOCAL_DIRS[run]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
