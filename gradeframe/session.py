"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime skew handling also where it costs one more shuffle further down.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the operators' plans count on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: The temporary folders of local sessions that set none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's checkpoint folder.

    Only a local master, where driver and executors are one machine, may leave it unset; a temporary
    folder then stands in for it, and the session's settings stay as they are.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = _local.get(context.applicationId) or tempfile.mkdtemp(prefix="gradeframe-")
        _local[context.applicationId] = path
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
