"""Cleaning vectors and folding equal ones, for the two embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_rows(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part. Only those of the most frequent length do (ties: the longer)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v")).where(
        "vec_id IS NOT NULL"
    ).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].dim if sizes else 0))


def fold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors folded: classes (rep, n, v) and members (vec_id, rep); rep is the smallest vec_id.

    Equality is that of the vectors' text, by its SHA-256. Rows that repeat an id and a vector count
    once. Only ids and digests are shuffled, and one vector per class.
    """
    keyed = rows.withColumn("key", F.sha2(F.col("v").cast("string"), 256))
    ids = staged(keyed.select("key", "vec_id").distinct(), "vector_ids")
    classes = ids.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    members = ids.join(classes.select("key", "rep"), "key").select("vec_id", "rep")
    firsts = keyed.withColumnRenamed("vec_id", "rep").join(classes, ["key", "rep"])
    return staged(firsts.dropDuplicates(["key"]).select("rep", "n", "v"), "vector_classes"), members


def smallest_members(members: DataFrame, most: int, spread: int = 64) -> DataFrame:
    """The `most` smallest vec_ids of every class, in two rounds so that no task holds a whole class."""
    count = Window.partitionBy("rep")
    few = members.groupBy("rep").agg(F.count("*").alias("n"))
    sized = members.join(few, "rep")
    small = sized.where(F.col("n") <= most).select("vec_id", "rep")
    ranked = sized.where(F.col("n") > most).select("vec_id", "rep", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).alias("lane"))
    for lanes in (None, 8):
        if lanes:
            ranked = ranked.withColumn("lane", F.col("lane") % lanes)
        lane = Window.partitionBy("rep", "lane").orderBy("vec_id")
        ranked = ranked.withColumn("at", F.row_number().over(lane)).where(F.col("at") <= most).drop("at")
    last = ranked.withColumn("at", F.row_number().over(count.orderBy("vec_id"))).where(F.col("at") <= most)
    return small.union(last.select("vec_id", "rep"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
