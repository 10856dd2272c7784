"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. Skewed join keys are split at run time, also where
# that costs one more shuffle; small inputs are joined by broadcast only below the threshold
# that Spark checks against the measured size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # tables bucketed by some of the keys of a join are joined bucket by bucket
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for written tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir``, the folder all executors share, or where that is
    unset below the warehouse. A warehouse on a local disk is no shared folder: outside local mode
    it is refused. ``clear_scratch`` deletes what a session has written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"executors do not share {base}: set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder they share")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


_scratch: list[str] = []
_cleared: list[Callable[[], None]] = []


def on_clear(forget: Callable[[], None]) -> None:
    """Have ``forget`` called whenever the scratch folders are deleted, to drop references to tables in them."""
    _cleared.append(forget)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this process; results that read them must be consumed before."""
    n = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for forget in _cleared:
        forget()
    return n


def scratch_mark() -> int:
    """The place in the list of scratch folders, for ``drop_scratch``."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Delete the scratch folders made since a mark but the newest: a step's result is kept, what it was made from goes."""
    end = max(mark, len(_scratch) - keep)
    for old in _scratch[mark:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _scratch[mark:end]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table written to the scratch folder.

    Used where one result feeds several branches of a plan: it is computed once, the lineage
    ends at the files, and losing an executor costs only a re-read. Lines and names repeat each
    other, so the files take less room than by Spark's default.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
