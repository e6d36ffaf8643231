"""Session builder with the settings the operators assume."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "engram", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; ``settings`` uses ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in tests, a
    temporary folder is made and kept in the session's settings; a cluster
    without the setting is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
