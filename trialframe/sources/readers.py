"""File readers with declared schemas and one missing value: NULL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.missing import nan_to_null
from ..functions.text import decimal_comma


def clean_name(name: str) -> str:
    """Lower-case identifier: runs of other characters become one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to an identifier, so no name needs quoting."""
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) != len(names) or "" in names:
        raise ValueError(f"column names collide or vanish once cleaned: {df.columns}")
    return df.toDF(*names)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats})


def _blank_to_null(df: DataFrame) -> DataFrame:
    """Empty texts, quoted or not, become NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in texts})


def _csv(spark, path, schema, sep, encoding) -> DataFrame:
    return _blank_to_null(
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma separated, header line, decimal point."""
    return normalise_missing(_csv(spark, path, schema, ",", "UTF-8"))


def read_csv_semicolon(
    spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8"
) -> DataFrame:
    """Semicolon separated, header line, decimal point."""
    return normalise_missing(_csv(spark, path, schema, ";", encoding))


def read_csv_decimal_comma(
    spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8"
) -> DataFrame:
    """Semicolon separated with decimal commas in the columns declared double."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.DoubleType) else f
            for f in schema
        ]
    )
    raw = _csv(spark, path, as_text, ";", encoding)
    return raw.withColumns(
        {
            f.name: decimal_comma(F.col(f"`{f.name}`"))
            for f in schema
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def read_typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Give the columns declared types; text that does not convert becomes NULL."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    typed = df.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    return normalise_missing(typed)


#: File in the folder of a run date that names its current version.
POINTER = "_current"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none where there is no such folder."""
    where, files = _place(spark, path)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where))


def pointer(spark: SparkSession, day: str) -> str | None:
    """The version that a run date's pointer names; None before the first."""
    where, files = _place(spark, f"{day}/{POINTER}")
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _current_versions(spark: SparkSession, base: str, days: list[str]) -> DataFrame:
    parts = []
    for name in days:
        version = pointer(spark, f"{base}/{name}")
        if version is not None:
            day = F.lit(name.removeprefix("run_date=")).cast("date").alias("run_date")
            parts.append(spark.read.parquet(f"{base}/{name}/{version}").select("*", day))
    if not parts:
        raise FileNotFoundError(f"no whole snapshot under {base}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_snapshot(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """Columnar table that carries its own schema.

    A folder of run dates (``writers.write_snapshot``) is read as the current version of each,
    with the date as ``run_date``. A table from elsewhere may hold NaN; with ``foreign`` it
    becomes NULL. Our own snapshots never do, and reading them as they are keeps filters
    pushed down.
    """
    days = [name for name in children(spark, path) if name.startswith("run_date=")]
    df = _current_versions(spark, path.rstrip("/"), days) if days else spark.read.parquet(path)
    return normalise_missing(df) if foreign else df
