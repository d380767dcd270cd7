"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a folder of our own, which also takes checkpoints."""
    global _own
    conf = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if conf:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(conf)
        return conf.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="helixar-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_own)
    return f"file://{_own}"


def held(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder, compressed and by columns, and read back; a small one is known to be small when it is joined."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
