"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders handed out so far, by application.
_made: dict[str, list[str]] = {}


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only if all tasks run in this
    process; on a cluster, executors would not see it, so that is an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not _local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(where)
    return where


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared one, as a URI or path. It lives until :func:`release`."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file through Spark's own file systems; False if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the shared folders that this application was handed, from the ``since``-th on; returns how many. Results
    that still read them must be stored before."""
    made = _made.get(spark.sparkContext.applicationId, [])
    gone = made[since:]
    del made[since:]
    return sum(remove(spark, path) for path in gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Shared folders handed out inside the block are deleted at its end."""
    since = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What an action inside the block has shuffled is deleted as the action ends, not when the driver happens to collect
    its garbage. For steps that store their results, so that no later one reads those files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that a DataFrame doesn't have yet (in any case of letters), made of the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
