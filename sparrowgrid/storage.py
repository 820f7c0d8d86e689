"""What driver and executors share: a folder, and bounds of the batches between them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Used where spark.checkpoint.dir is unset and everything runs in one place, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a cluster it must be set, as no machine's own folder will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bound_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches of at most so many MB, since one text may be very long.

    Plans run after the operators return, so the session keeps the bounds; tighter ones that it has already stay.
    """
    for name, most in (("maxRecordsPerBatch", 4000), ("maxBytesPerBatch", megabytes << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")  # a bare number, or one of bytes
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
