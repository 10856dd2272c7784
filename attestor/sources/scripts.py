"""Scripts: text files of any size, read as line rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor import fixed


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, line_no, line) of every UTF-8 file below a path, lines numbered from 1.

    Files are read in blocks; the lines of a block keep their order, and blocks begin at the sum
    of the lines before them, so a file of any size is many tasks.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select(F.col("_metadata.file_path").alias("script_id"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")))
    block = ["script_id", "_block"]
    earlier = Window.partitionBy("script_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (lines.groupBy(*block).agg(F.count("*").alias("_n"))
              .select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    number = F.col("_start") + F.row_number().over(Window.partitionBy(*block).orderBy("_at"))
    return lines.join(starts, block).select("script_id", number.alias("line_no"), "line")


def oversize_files(spark: SparkSession, path: str, limit: int = fixed.MAX_SCRIPT_BYTES) -> DataFrame:
    """Files above the limit with their length; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > limit).select(F.col("path").alias("script_id"), "length")


def split_oversize(scripts: DataFrame, limit: int = fixed.MAX_SCRIPT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(scripts up to the limit, those above it), by the size of their text."""
    size = F.octet_length("sql")
    return scripts.filter(size <= limit), scripts.filter(size > limit)
