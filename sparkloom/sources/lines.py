"""Lines: their sources, ids and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """A row a line of the text column: the keys, line_no from 1, text. A null text has no line."""
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def dropped_bytes(c: Column) -> Column:
    """Text without the bytes that are no UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (path, line_no, text), without invalid bytes; line_no follows the file from 1.

    Files are read in splits. A first scan counts the lines of each split, so that a line's
    number is that of the lines of the splits before and its place in its own; no text moves."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # both scans need the same splits, which follow the number of cores otherwise
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    splits = raw.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("path", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("base"))
    return raw.join(base, ["path", "split"]).select("path", (F.col("id") + F.col("base")).alias("line_no"), dropped_bytes(F.col("text")).alias("text"))


def from_strings(spark: SparkSession, found: list[bytes], path: str = "-") -> DataFrame:
    """Lines that the driver holds already, as read_text gives them."""
    rows = [(path, i, line.decode("utf-8", "ignore")) for i, line in enumerate(found, 1)]
    return spark.createDataFrame(rows, "path string, line_no bigint, text string")


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream of lines; lines are independent of each other, so order doesn't matter."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def line_id(c: Column) -> Column:
    """The first word of a line, null if the line has no sentence behind it."""
    return F.nullif(F.regexp_extract(c, r"^(\S+)\s+\S", 1), F.lit(""))


def sentence(c: Column) -> Column:
    """The line without its id."""
    return F.regexp_extract(c, r"^\S+\s+(\S|\S[^\n]*\S)\s*$", 1)
