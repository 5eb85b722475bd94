"""Python workers: the path of this package and the size of the batches they get."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = 16 << 20
#: Workers stay between tasks: arrays of a megabyte or more go back to the system when freed, those of Arrow too.
GIVE_BACK = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, bounds their Arrow batches and has them give freed memory back. On a cluster, submit the package with --py-files or install it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    now = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in now.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, now) if x)
    env.update(GIVE_BACK)
