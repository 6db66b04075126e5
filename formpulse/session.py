"""Runtime SQL settings the plans are tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # The JVM never compiles a method above 8000 bytes of bytecode. A wide stage (28 answers per
    # form) generates one such method and would run interpreted; with this limit Spark splits the
    # stage into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; they act on plans executed from then on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def work_folder(spark: SparkSession) -> str:
    """A new folder name for written tables and stream checkpoints.

    It lies in the shared folder that the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset, as in a local test, is it a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="formpulse-")
    return f"{base}/formpulse-{uuid.uuid4().hex}"
