"""The folder that driver and executors share, and tables written there to cut the lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


SWEEP = 15  #: seconds between sweeps, at least
_swept = [0.0]
_open: ContextVar[list | None] = ContextVar("tables written in the scratch at hand", default=None)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, which a cluster must name."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="claimweave-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation.

    The table is deleted when the application ends. Zstandard is compressed in streams: other codecs keep direct buffers
    of the largest page for each column, beside the heap.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    if (held := _open.get()) is not None:
        held.append(out)
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are gone: it does so only when the driver has collected its garbage, which many small rounds don't bring about."""
    if time.monotonic() - _swept[0] >= SWEEP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


def discard(*cuts: DataFrame) -> None:
    """Deletes the tables of what written() returned, once nothing will read them again; other frames are left alone."""
    for df in cuts:
        if path := getattr(df, "_cut", None):
            sweep(df.sparkSession)
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch():
    """Deletes on leaving all tables that were written within, but those handed to the function that it gives, which returns them.

    What is left may read only the tables kept.
    """
    held, kept = [], set()
    token = _open.set(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._cut)
        return df

    give: Callable[[DataFrame], DataFrame] = keep
    try:
        yield give
    finally:
        _open.reset(token)
        discard(*(df for df in held if df._cut not in kept))
        if (outer := _open.get()) is not None:
            outer.extend(df for df in held if df._cut in kept)
