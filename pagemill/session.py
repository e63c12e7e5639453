"""Session settings and scratch locations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "pagemill", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Pages are wide rows that grow when parsed; keep read splits moderate.
        "spark.sql.files.maxPartitionBytes": "64m",
        # A batch of whole pages goes to a Python worker; keep it small.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        # Whole-store rewrites are never wanted; only touched partitions are replaced.
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of one Arrow batch where the session sets none, or a larger number.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, so that many long texts never meet in one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = str(spark.conf.get(key)).strip().lower().removesuffix("b")
    if value[-1:] in "kmg":
        value = str(int(value[:-1]) << {"k": 10, "m": 20, "g": 30}[value[-1]])
    if not value.isdigit() or not 0 < int(value) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables and stream checkpoints.

    On a cluster it lies under ``spark.checkpoint.dir`` so that every executor
    sees it; only where that is unset (tests, local runs) a temporary folder is used.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if base:
        return f"{base.rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"pagemill-{name}-")
