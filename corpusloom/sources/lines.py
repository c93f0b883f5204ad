"""Lines of text files that many tasks read at once, with the line numbers that single readers would give them.

Files are read by byte ranges. A line's number is its place in its range behind all lines of earlier ranges of the file:
lines are counted per range, and a running sum over a file's ranges, of which there are few, does the rest. Only the lines
that are asked for get a number, so a scan shuffles nothing but a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A line's file, the first byte of its range, and its place among the rows of its task, which reads ranges in order.
PLACE = ("path", "block", "at")


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, at, value`` of all lines, blank ones too; a line ends at a line feed, with a carriage return before it or not."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    return lines.select(*where, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))


def ranges(lines: DataFrame, **counted: Column) -> DataFrame:
    """A row for each range: ``path, block, first, before`` (the lines of the file before it), and the aggregates ``counted``."""
    sums = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counted.items()])
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")


def line_number(at: Column | str = "at") -> Column:
    """From 1, of the row at ``at`` of the range whose ``first`` and ``before`` stand beside it."""
    return F.col("before") + (F.col(at) if isinstance(at, str) else at) - F.col("first") + 1


def numbered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows``, some of the lines, with ``line_no``; ``found`` are the ranges of the same reading of the files."""
    return rows.join(found.select("path", "block", "first", "before"), ["path", "block"]).withColumn("line_no", line_number()).drop("first", "before")
