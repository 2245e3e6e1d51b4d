"""Where intermediate tables go.

The cluster names a folder that every executor sees in ``spark.checkpoint.dir``.
Only when that is unset, as in a local test, do we choose one ourselves.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folders made here, by application; a setting of a running session cannot be changed.
_MADE: dict[str, str] = {}
#: Open scopes, innermost last: the paths that each one drops at its end.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; locally, without one, a folder removed at exit."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    if context.applicationId not in _MADE:
        folder = _MADE[context.applicationId] = tempfile.mkdtemp(prefix="trialframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _MADE[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path through the file system that it belongs to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Drop, at the end of the block, every path made within it.

    Results that read these paths must have been written before the block ends.
    """
    scope: list[str] = []
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        for path in scope:
            drop_path(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Compute a table once and read it back from the shared folder.

    For results that several passes follow. The written files outlive lost
    executors, and later plans start from a scan with known sizes.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
