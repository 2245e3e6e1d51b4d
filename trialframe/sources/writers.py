"""Table writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .readers import POINTER, children, normalise_missing, pointer
from .scratch import drop_path


def write_snapshot(df: DataFrame, base: str, run_date: str) -> str:
    """Write the table as the snapshot of its run date; returns the date's folder.

    A version is written beside the earlier ones, and only when it is whole does a small
    file that names it, the date's pointer, take the place of the last one in one step.
    Until then readers of ``read_snapshot`` see the earlier version, also if the write fails.
    The version before stays for readers that have started on it; older ones go.
    """
    day = f"{base.rstrip('/')}/run_date={run_date}"
    version = f"version={uuid.uuid4().hex}"
    normalise_missing(df).write.parquet(f"{day}/{version}")
    before = pointer(df.sparkSession, day)
    _switch(df.sparkSession, day, version)
    for old in children(df.sparkSession, day):
        if old.startswith("version=") and old not in (version, before):
            drop_path(df.sparkSession, f"{day}/{old}")
    return day


def _switch(spark: SparkSession, day: str, version: str) -> None:
    """Let the pointer name the version: written beside, then renamed over the old one."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, place = (jvm.org.apache.hadoop.fs.Path(f"{day}/{name}") for name in (f"_{version}", POINTER))
    stream = fresh.getFileSystem(configuration).create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), configuration).rename(fresh, place, options)


def write_result_csv(df: DataFrame, path: str, sep: str = ",", files: int | None = None) -> str:
    """Write a result table with a header line.

    It keeps its partitions. For a known small table ``files`` names how many files
    come out; its rows are shuffled into them, so earlier steps stay as they are.
    """
    out = df if files is None else df.repartition(files)
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path
