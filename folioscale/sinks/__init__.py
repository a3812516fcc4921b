"""Sinks (SNK-01 to SNK-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """SNK-01, SNK-06: one JSON text a row, columns in the order of their names, by Spark's commit protocol."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    """SNK-02: records added as JSON lines."""
    df.write.mode("append").json(path)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each key the row that comes last."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: str) -> None:
    """SNK-03, SNK-08: a keyed Parquet table in versions: all columns of a key's last row win.

    A version is written beside the old one and then named in ``_current``, so a reader never sees half.
    """
    old = current(spark, path)
    merged = latest(rows if old is None else old.unionByName(rows, allowMissingColumns=True), keys, order)
    version = (-1 if old is None else int(_pointer(spark, path))) + 1
    merged.write.mode("overwrite").parquet(f"{path}/v={version}")
    spark.createDataFrame([(str(version),)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")


def changed(spark: SparkSession, path: str, keys: Sequence[str], rows: DataFrame, flags: dict[str, Column] | None = None) -> None:
    """SNK-08: the rows of the given keys are removed from a keyed table, or get new values in some columns (flags)."""
    old = current(spark, path)
    if old is None:
        return
    picked = rows.select(*keys).distinct()
    rest = old.join(picked, list(keys), "left_anti")
    new = rest if flags is None else rest.unionByName(old.join(picked, list(keys), "left_semi").withColumns(flags))
    version = int(_pointer(spark, path)) + 1
    new.write.mode("overwrite").parquet(f"{path}/v={version}")
    spark.createDataFrame([(str(version),)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")


def _pointer(spark: SparkSession, path: str) -> str | None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    return spark.read.text(f"{path}/_current").first()["value"] if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs) else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's current version; null before the first."""
    version = _pointer(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v={version}")


def write_text(pieces: DataFrame, path: str, group: str = "job_id") -> None:
    """SNK-04: the pieces of ``journal.assembled`` as text files, a folder for each job, in order.

    A job's pieces meet in one task and are streamed in sorted order; jobs spread over all tasks.
    """
    df = pieces.repartition(group).sortWithinPartitions(group, "position")
    rows = df.select(F.col(group).alias("job"), F.regexp_replace("piece", r"\n\z", "").alias("piece"))  # the writer ends each row with LF
    rows.write.mode("overwrite").partitionBy("job").text(path)
