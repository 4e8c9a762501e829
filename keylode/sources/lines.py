"""Line files with the place of each line.

Only a line feed ends a line; carriage returns and bytes that aren't UTF-8 stay.  The
offset of a line is the length of what stands before it: a running sum within each
block that a task reads, moved by the totals of the blocks before.  Files are read by
Spark, from any store it knows, in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    """file_idx, src_off, len, line (binary) of one file."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line")
    )
    sized = raw.withColumn("size", F.octet_length("line").cast("long"))
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = sized.groupBy("file", "block").agg(F.sum(F.col("size") + 1).alias("total"))
    base = total.select("file", "block", F.coalesce(F.sum("total").over(blocks), F.lit(0)).alias("base"))
    own = sized.withColumn("own", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)))
    return own.join(F.broadcast(base), ["file", "block"]).select(
        F.lit(file_idx).alias("file_idx"), (F.col("base") + F.col("own")).cast("long").alias("src_off"), F.col("size").cast("int").alias("len"), "line"
    )


def keyed(rows: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """lines with their key; lines without one, and empty keys, are skipped."""
    return rows.withColumn("key", key(F.col("line"))).where("key is not null and octet_length(key) > 0")


def sources(spark: SparkSession, paths: Sequence[str], key: Callable[[Column], Column], first: int = 0) -> DataFrame:
    """The keyed lines of files in precedence order, lowest first."""
    return reduce(DataFrame.unionByName, [keyed(lines(spark, p, first + i), key) for i, p in enumerate(paths)])
