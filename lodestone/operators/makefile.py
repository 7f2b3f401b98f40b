"""Build rules for systems that depend on one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name


def spec_file(system: Column, folder: str) -> Column:
    return F.concat(F.lit(folder), safe_name(system), F.lit(".json"))


def index_file(system: Column, folder: str) -> Column:
    return F.concat(F.lit(folder), safe_name(system), F.lit(".db"))


def edges(systems: DataFrame) -> DataFrame:
    """(system_name, dependency): one row for each dependency."""
    return systems.select("system_name", F.explode("dependencies").alias("dependency"))


def names(systems: DataFrame, analyze: str, index: str) -> DataFrame:
    """(system_name, spec_file, index_file)."""
    return systems.select("system_name", spec_file(F.col("system_name"), analyze).alias("spec_file"), index_file(F.col("system_name"), index).alias("index_file"))


def rules(systems: DataFrame, dist: str, analyze: str, index: str) -> DataFrame:
    """(system_name, analyze_rule, index_rule): each system's two rules."""
    needs = F.array_join(F.transform("dependencies", lambda d: spec_file(d, analyze)), " ")
    out, db = spec_file(F.col("system_name"), analyze), index_file(F.col("system_name"), index)
    one = F.concat(out, F.lit(":"), F.when(F.size("dependencies") > 0, F.concat(F.lit(" "), needs)).otherwise(""), F.lit("\n\tanalyze "), F.col("system_name"), F.lit(f" {dist} "), out, F.lit("\n"))
    two = F.concat(db, F.lit(": "), out, F.lit("\n\tindex "), out, F.lit(" "), db, F.lit("\n"))
    return systems.select("system_name", "no", one.alias("analyze_rule"), two.alias("index_rule"))


def makefile(systems: DataFrame, dist: str, analyze: str, index: str) -> DataFrame:
    """(text): the whole file, one row.  It has as many lines as the list of systems."""
    every = names(systems, analyze, index).join(rules(systems, dist, analyze, index), "system_name")
    parts = every.agg(F.array_sort(F.collect_list(F.struct("no", "spec_file", "index_file", "analyze_rule", "index_rule"))).alias("r"))
    each = lambda c: F.transform("r", lambda x: x[c])
    target = lambda name, files: F.concat(F.lit(f"{name}: "), F.array_join(files, " \\\n" + " " * (len(name) + 2)), F.lit("\n\n"))
    text = F.concat(target("all", F.concat(each("spec_file"), each("index_file"))), target("analyze", each("spec_file")), target("index", each("index_file")), F.array_join(each("analyze_rule"), ""), F.lit("\n"), F.array_join(each("index_rule"), ""))
    return parts.select(text.alias("text"))
