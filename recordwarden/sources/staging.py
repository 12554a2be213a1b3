"""Writing an intermediate table once so that several outputs can read it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = "_place"


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; in local mode one in the warehouse will do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging").rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/recordwarden/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet and read it back. Survives the loss of any executor."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_places(df: DataFrame, name: str) -> DataFrame:
    """`staged`, with a number in the column `PLACE` that tells all rows apart, equal ones too.

    It is a hash of the row's file and position there, the same in every later read.
    """
    return staged(df, name).withColumn(PLACE, F.xxhash64("_metadata.file_name", "_metadata.row_index"))


def numbered(df: DataFrame, order: Sequence[Column], name: str, column: str = "position") -> DataFrame:
    """`df` with the place of every row in the given order, from 1 without gaps, in `column`.

    The sorted rows are written once, one file per range of the order. A row's place is its
    position in its file plus the rows of all earlier files, so no task holds more than a range.
    Rows that are equal in `order` have places next to each other, the same in every later read.
    """
    rows = staged(df.orderBy(*order), name).withColumns({
        "_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index"),
    })
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    # One row per written file reaches this window.
    earlier = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = (F.col("_before") + F.col("_row") + 1).cast("long").alias(column)
    # Unasked, Spark shuffles the rows by file: it does not know how few offsets there are.
    return rows.join(F.broadcast(offsets), "_file").select(place, *df.columns)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    delete_folder(spark, path.rsplit("/", 1)[0])


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
