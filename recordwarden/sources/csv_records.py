"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks.

A file is read line by line, in splits. A line that starts outside quotes ends inside or outside
them, and so does one that starts inside: two bits per line. A line whose bits are equal settles the
state; any other keeps or turns it. The state before a line is therefore the last settled one, turned
as often as there were turning lines since. It is worked out per split first and over the splits'
summaries second, so no task holds more than a split. Only lines of records that really go on in
the next line are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A cell is quoted, or does not start with a quote; quotes further inside it are part of it.
_QUOTED_REST = r'(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:"{_QUOTED_REST}|[^",][^,]*+)?+'
_FROM_OUTSIDE = rf"^{_CELL}(?:,{_CELL})*+$"
_FROM_INSIDE = rf"^{_QUOTED_REST}(?:,{_CELL})*+$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split, line, opens, stays): does the line end inside quotes, if it starts outside or inside them?"""
    value = F.col("value")
    quotes = F.contains(value, F.lit('"'))
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        (quotes & ~F.rlike(value, F.lit(_FROM_OUTSIDE))).alias("opens"),
        (~quotes | ~F.rlike(value, F.lit(_FROM_INSIDE))).alias("stays"),
    )


def has_line_breaks(spark: SparkSession, path: str) -> str | None:
    """The first line found that goes on in the next one, None if there is no such line."""
    found = _lines(spark, path).where("opens").first()
    return found and found.value


def _states(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `from_out` and `from_in`: is the state after a row inside, if it was outside or inside before the first row of its keys?"""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = (F.col("opens") & ~F.col("stays")).cast("int")
    settled = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("inside"), F.col("turns").alias("turns")))
    counted = rows.withColumn("turns", F.sum(turns).over(so_far)).withColumn("settled", F.last(settled, ignorenulls=True).over(so_far))
    odd = (F.col("turns") - F.coalesce("settled.turns", F.lit(0))) % 2 == 1

    def after(first: bool) -> Column:
        return F.coalesce("settled.inside", F.lit(first)) != odd

    return counted.withColumns({"from_out": after(False), "from_in": after(True)}).drop("turns", "settled")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, is_header, record): every record of the files, line breaks inside quotes included, blank lines left out.

    The first record of each file is its header. A quote that is never closed stops the read.
    """
    lines = _states(_lines(spark, path), ["file", "split"], "line")
    within = Window.partitionBy("file", "split").orderBy("line")
    lines = lines.withColumns({
        "before_out": F.lag("from_out", 1, False).over(within), "before_in": F.lag("from_in", 1, True).over(within),
    })
    # One row per split from here to the join; a split has the two bits of all its lines together.
    ends = lines.groupBy("file", "split").agg(
        F.max_by("from_out", "line").alias("opens"), F.max_by("from_in", "line").alias("stays"),
        F.max(F.when(~F.col("before_out"), F.col("line"))).alias("last_out"),
        F.max(F.when(~F.col("before_in"), F.col("line"))).alias("last_in"),
    )
    splits = Window.partitionBy("file").orderBy("split")
    earlier = splits.rowsBetween(Window.unboundedPreceding, -1)
    ends = _states(ends, ["file"], "split").withColumn("inside", F.lag("from_out", 1, False).over(splits))
    last = F.when(F.col("inside"), F.col("last_in")).otherwise(F.col("last_out"))
    is_last = F.lead("split").over(splits).isNull()
    unclosed = F.raise_error(F.concat(F.lit("a quote is never closed in "), "file")).cast("boolean")
    ends = ends.withColumns({
        "carried": F.last(F.when(last.isNotNull(), F.struct("split", last.alias("line"))), ignorenulls=True).over(earlier),
        "closed": F.when(is_last & F.col("from_out"), unclosed).otherwise(F.lit(True)),
    }).where("closed").select("file", "split", "inside", "carried")

    joined = lines.join(ends, ["file", "split"])
    starts = ~F.when(F.col("inside"), F.col("before_in")).otherwise(F.col("before_out"))
    goes_on = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))
    blank = F.trim(F.regexp_replace("value", "\r$", "")) == ""
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    marked = joined.withColumns({"starts": starts, "goes_on": goes_on}).where(~(F.col("starts") & blank))
    opened = F.last(F.when(F.col("starts"), F.struct("split", "line")), ignorenulls=True)
    marked = marked.withColumn("record_start", F.coalesce(opened.over(so_far), F.col("carried"))).withColumn(
        "first_line", F.min(F.when((F.col("split") == 0) & F.col("starts"), F.col("line"))).over(Window.partitionBy("file", "split"))
    )
    is_header = F.coalesce((F.col("split") == 0) & (F.col("line") == F.col("first_line")), F.lit(False))
    columns = ["file", "is_header", F.regexp_replace("record", "\r$", "").alias("record")]
    whole = marked.where(F.col("starts") & ~F.col("goes_on")).select("file", is_header.alias("is_header"), F.col("value").alias("record"))
    parts = marked.where(~F.col("starts") | F.col("goes_on")).groupBy("file", "record_start").agg(
        F.max(is_header).alias("is_header"), F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("parts"),
    )
    glued = parts.select("file", "is_header", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    return whole.union(glued).select(*columns)
