"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def session_zone(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def has_fixed_offset(zone: str) -> bool:
    """True when the zone never changes its offset by part of a clock hour or at all."""
    return bool(re.fullmatch(r"(Etc/)?(UTC|GMT|Zulu|UCT)|Z|[+-]\d{1,2}(:\d{2}){0,2}", zone))


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``, or the caller has set it with
    ``SparkContext.setCheckpointDir``; without either this is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def new_work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends.

    Nothing is at the path yet; the folder around it is what is removed.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return f"{path}/{name}"
