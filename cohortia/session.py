"""Session helpers: shared scratch folder, lineage cuts, null-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session's ``spark.checkpoint.dir`` names it.

    A session that runs in this process alone (``local``, as in tests) gets a temporary folder where
    the setting is absent; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortia-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one table below the shared folder, deleted when this process ends or by `release`."""
    path = f"{shared_dir(spark).rstrip('/')}/cohortia/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_release_at_exit)
    _SCRATCH.append((spark, path))
    return path


def release(since: int = 0) -> None:
    """Delete the scratch tables made after the first ``since`` ones; frames that read them are then of no use."""
    for spark, path in _SCRATCH[since:]:
        if getattr(getattr(spark, "sparkContext", None), "_jsc", None) is None:
            continue  # the session is gone
        delete(spark, path)
    del _SCRATCH[since:]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, or a folder of one, that no frame reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the session's JVM may be gone; its shared folder is then the caller's to clear
        _SCRATCH.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the scratch tables made inside; run the actions inside as well."""
    since = len(_SCRATCH)
    try:
        yield
    finally:
        release(since)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The table outlives lost executors, is computed once, and its known size lets Spark pick joins.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def ending_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table written inside are deleted when it is written (before Spark 4.1: when the driver collects its garbage)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of a table from which on its lookups are hashed, and of a sorted partition.
MANY_ROWS, SORTED_ROWS = 2_000_000, 250_000


def lookup_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a side of unique keys, for a join with a table of ``rows`` rows: beyond `MANY_ROWS` it is hashed in each partition.

    A sort-merge join sorts the many rows as well, in partitions put together by their size as written, of which a task's memory is a
    multiple. Hashed keys leave them as they are, hot keys can still be split, and the memory is that of the unique keys of a partition.
    """
    return df.hint("shuffle_hash") if rows > MANY_ROWS else df


def sorted_by(df: DataFrame, rows: int, *by: Column | str) -> DataFrame:
    """``df`` of about ``rows`` rows in the order of ``by``; beyond `MANY_ROWS` a partition is dealt `SORTED_ROWS` of them."""
    if rows <= MANY_ROWS:
        return df.orderBy(*by)
    return df.repartitionByRange(-(-rows // SORTED_ROWS), *by).sortWithinPartitions(*by)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys meet NULL keys; keeps the left key columns."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
