"""Dated snapshots of report tables, and named result tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = "snapshot_date"


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """The folder that holds each committed date under ``path``: the one its marker in ``_commits`` names, else (for snapshots written
    before markers existed) the plain date folder. No data file is opened."""
    place, store = _store(spark, path)
    if not store.exists(place):
        return {}
    found = {}
    for entry in store.listStatus(place):
        name = entry.getPath().getName()
        if name.startswith(f"{SNAPSHOT}="):
            found[dt.date.fromisoformat(name.split("=", 1)[1])] = _folder(path, dt.date.fromisoformat(name.split("=", 1)[1]))
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_commits")
    if store.exists(marks):
        for entry in store.listStatus(marks):
            name = entry.getPath().getName()
            if name.startswith("."):
                continue
            stream = store.open(entry.getPath())
            try:
                attempt = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
            finally:
                stream.close()
            found[dt.date.fromisoformat(name)] = f"{path.rstrip('/')}/_attempts/{attempt}"
    return found


def _snapshot_dates(spark: SparkSession, path: str) -> list[dt.date]:
    """Dates of the committed snapshots under ``path``."""
    return sorted(_committed(spark, path))


def _folder(path: str, date: dt.date) -> str:
    return f"{path.rstrip('/')}/{SNAPSHOT}={date.isoformat()}"


def read_latest_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, before: dt.date | None = None
) -> DataFrame:
    """The newest committed snapshot under ``path`` (optionally older than ``before``), with the columns it was stored with.

    Only the folder of its date is read. Without a snapshot there are no rows, and the columns are those of ``schema``. A write that
    died before it was published is never read.
    """
    committed = _committed(spark, path)
    dates = [d for d in sorted(committed) if before is None or d < before]
    return spark.read.parquet(committed[dates[-1]]) if dates else spark.createDataFrame([], schema)


def union_history(current: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current and historic rows by column name, one row per key; the current one wins.

    Columns only one side has are null on the other. Among several historic rows for a key the
    greatest one stays, so the result does not depend on row order.
    """
    both = current.withColumn("__rank", F.lit(1)).unionByName(
        history.withColumn("__rank", F.lit(0)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in keys and c != "__rank"]
    kept = both.groupBy(*keys).agg(F.max(F.struct("__rank", *rest)).alias("__row"))
    columns = [c for c in both.columns if c != "__rank"]
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns])


def stage_snapshot(df: DataFrame, path: str) -> str:
    """Write the rows under a fresh attempt folder that no reader looks at yet; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/_attempts/{attempt}")
    return attempt


def publish_snapshot(spark: SparkSession, path: str, snapshot_date: dt.date, attempt: str) -> None:
    """Make a staged attempt the snapshot of its date: its name goes into a hidden marker file, which a rename then puts in place.

    The rename is the only step readers can see, so a date shows either its old or its new rows, never a half-written folder.
    """
    _, store = _store(spark, path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    marks = f"{path.rstrip('/')}/_commits"
    hidden = fs_path(f"{marks}/.{snapshot_date.isoformat()}-{attempt}")
    stream = store.create(hidden, True)
    try:
        stream.write(bytearray(attempt.encode()))
    finally:
        stream.close()
    final = fs_path(f"{marks}/{snapshot_date.isoformat()}")
    if store.exists(final):
        store.delete(final, False)
    if not store.rename(hidden, final):
        raise OSError(f"could not publish the snapshot of {snapshot_date} under {path}")


def write_snapshot(df: DataFrame, path: str, snapshot_date: dt.date) -> None:
    """Write one dated snapshot; writing the same date again replaces that date, also by a table without rows.

    The rows are staged first and published after, so a job that dies on the way leaves the previous snapshot of the date readable.
    """
    publish_snapshot(df.sparkSession, path, snapshot_date, stage_snapshot(df, path))


def append_snapshot(
    df: DataFrame, path: str, snapshot_date: dt.date, keys: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Write a snapshot of ``df`` together with the history before that date, and return it.

    Columns that only ``df`` or only the history has are kept, null on the other side. Repeating a date gives the same snapshot again, as a
    rerun never reads its own output.
    """
    spark = df.sparkSession
    history = read_latest_snapshot(spark, path, schema or df.schema, before=snapshot_date)
    write_snapshot(union_history(df, history, keys), path, snapshot_date)
    return spark.read.parquet(_committed(spark, path)[snapshot_date])


def write_results(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write named result tables, each to its own folder; returns where they went."""
    places = {}
    for name, table in tables.items():
        places[name] = f"{path.rstrip('/')}/{name}"
        writer = table.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(places[name])
    return places
