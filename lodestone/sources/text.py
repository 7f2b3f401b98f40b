"""Files as rows: one for each file, or one for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, body) of whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(_path().alias("filename"), F.col("value").alias("body"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, no, line): the lines of small list files, numbered from 0; the empty one
    after a final line feed is left out."""
    rows = files(spark, *paths).select("filename", F.posexplode(F.split("body", "\r?\n", -1)).alias("no", "line"), F.size(F.split("body", "\r?\n", -1)).alias("n"))
    return rows.filter((F.col("no") < F.col("n") - 1) | (F.col("line") != "")).select("filename", "no", "line")


def _path():
    # file:///x and file:/x are the same file as /x
    return F.regexp_replace("_metadata.file_path", "^file:/+", "/")
