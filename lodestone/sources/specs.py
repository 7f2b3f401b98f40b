"""Analyser output: one JSON file for each system, with its files and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SPEC

_BAD = "_corrupt_record"


def read(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(specs, rejected): the specs with the file that each is from, missing text as empty
    text and missing lists as empty lists; and (spec_file, raw) of files that aren't specs."""
    rows = spark.read.schema(f"{SPEC}, {_BAD} string").json(list(paths), multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD)
    rows = rows.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("spec_file"), "*")
    good = F.col(_BAD).isNull() & F.col("system_name").isNotNull()
    specs = rows.filter(good).drop(_BAD)
    for c in ("asd_file", "root_directory"):
        specs = specs.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("files", "definitions"):
        specs = specs.withColumn(c, F.coalesce(c, F.array().cast(specs.schema[c].dataType)))
    return specs, rows.filter(~good).select("spec_file", F.col(_BAD).alias("raw"))


def statuses(specs: DataFrame, rejected: DataFrame) -> DataFrame:
    """(spec_file, system_name, status) of all files: success, or failure, then without a name."""
    good = specs.select("spec_file", "system_name", F.lit("success").alias("status"))
    return good.unionByName(rejected.select("spec_file", F.lit(None).cast("string").alias("system_name"), F.lit("failure").alias("status")))
