"""Lists of Lisp systems and releases: lines of blank-separated words, the last ones variadic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, without_extension
from .text import numbered_lines


def _words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.split("line", "[ \t]", -1))


def systems(spark: SparkSession, path: str) -> DataFrame:
    """(project, system_file, system_name, dependencies, no); lines that begin with # are comments."""
    return parsed_systems(numbered_lines(spark, path).filter(~F.startswith("line", F.lit("#"))))


def listed_systems(spark: SparkSession, path: str) -> DataFrame:
    """As ``systems``, of a list whose first line is a header, whatever it is."""
    return parsed_systems(numbered_lines(spark, path).filter("no > 0"))


def parsed_systems(lines: DataFrame) -> DataFrame:
    """(project, system_file, system_name, dependencies, no) of lines (no, line)."""
    tail = F.filter(F.slice("w", 4, F.greatest(F.size("w") - 3, F.lit(0))), lambda x: x != "")
    return _words(lines).select(F.get("w", F.lit(0)).alias("project"), F.get("w", F.lit(1)).alias("system_file"), F.get("w", F.lit(2)).alias("system_name"), tail.alias("dependencies"), "no")


def releases(spark: SparkSession, path: str) -> DataFrame:
    """(project, url, size, file_md5, content_sha1, prefix, system_files): the last line of
    each project; the first line is a header."""
    return parsed_releases(numbered_lines(spark, path).filter("no > 0"))


def parsed_releases(lines: DataFrame) -> DataFrame:
    """Releases of lines (no, line)."""
    names = ("project", "url", "size", "file_md5", "content_sha1", "prefix")
    tail = F.filter(F.slice("w", 7, F.greatest(F.size("w") - 6, F.lit(0))), lambda x: x != "")
    rows = _words(lines).select(*[F.get("w", F.lit(k)).alias(c) for k, c in enumerate(names)], tail.alias("system_files"), "no")
    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("no"))))
    return last.filter("_k = 1").drop("_k", "no")


def by_project(found: DataFrame) -> DataFrame:
    """(project, system_names): the systems of each project, in alphabetical order."""
    return found.groupBy("project").agg(F.array_sort(F.collect_list("system_name")).alias("system_names"))


def system_files(found: DataFrame, released: DataFrame, root: str = "") -> DataFrame:
    """(system_name, asd_file): the definition file of each system, the first in its
    release whose name without extension is the system's file; null if there is none."""
    stem = lambda f: without_extension(base_name(f)) == F.col("system_file")
    file = F.get(F.filter("system_files", stem), F.lit(0))
    return found.join(released.select("project", "prefix", "system_files"), "project").select("system_name", F.concat(F.lit(root), F.col("prefix"), F.lit("/"), file).alias("asd_file"))
