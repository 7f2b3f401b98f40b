"""Symbols, packages and their definitions: from analyser output, or from the text itself."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity, relative_path


def numbered(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` with doc_id: 1, 2, ... over all shards, in order of shards and in each by ``order``.

    Rows are numbered inside each shard and moved by the sizes of the shards before; no
    sort of all rows, and only the shards' sizes, one number each, meet in one task.
    """
    local = rows.withColumn("_k", F.row_number().over(Window.partitionBy(shard).orderBy(*order)))
    sizes = rows.groupBy(shard).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(shard).alias("_shard"), before.alias("_before"))
    return local.join(offsets, local[shard] == offsets["_shard"]).withColumn("doc_id", F.col("_before") + F.col("_k")).drop("_k", "_before", "_shard")


def index_specs(specs: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The relations of specs, by name, but for the index, which is made of ``document``.

    Each spec's first document is its system file, with the texts of its files after it.
    ``sources``: (filename, body); a file that isn't there has no body and no postings.
    An identifier without locations is still a symbol or package; a definition in a file
    that isn't the spec's is in document 0; a location without file or position is none.
    An identifier that a spec has twice is one symbol or package with the definitions of both.
    """
    listed = specs.select("spec_file", "system_name", "root_directory", "asd_file", "time", F.posexplode(F.concat(F.array("asd_file"), "files")).alias("no", "path"))
    # a file that a spec names twice is one document
    listed = listed.groupBy("spec_file", "path").agg(F.min("no").alias("no"), *[F.first(c).alias(c) for c in ("system_name", "root_directory", "asd_file", "time")])
    listed = numbered(listed, "spec_file", "no")
    bodies = sources.select(F.col("filename").alias("path"), "body")
    document = listed.join(bodies, "path", "left").select("doc_id", relative_path(F.col("path"), F.col("root_directory")).alias("filename"), "body")
    system = specs.select("spec_file", "system_name", "time", F.col("asd_file").alias("path")).join(listed.select("spec_file", "path", "doc_id"), ["spec_file", "path"])
    system = system.select(identity(F.lit("system"), F.col("spec_file")).alias("system_id"), F.col("system_name").alias("name"), "doc_id", F.col("time").alias("analyzed_time"))
    found = specs.select("spec_file", F.explode("definitions").alias("d")).select("spec_file", "d.identifier.*", "d.locations")
    odd = ~F.col("type").isin("symbol", "package")
    found = found.withColumn("type", F.when(F.col("type").isNull() | odd, F.raise_error(F.concat(F.lit("no such kind of definition: "), F.coalesce("type", F.lit("null"))))).otherwise(F.col("type")))
    package = F.coalesce("package", F.lit(""))
    named = found.withColumn("id", F.when(F.col("type") == "symbol", identity(F.lit("symbol"), F.col("spec_file"), package, F.col("name"))).otherwise(identity(F.lit("package"), F.col("spec_file"), F.col("name"))))
    symbol = named.filter("type = 'symbol'").select(F.col("id").alias("symbol_id"), "name", package.alias("package_name")).distinct()
    packages = named.filter("type = 'package'").select(F.col("id").alias("package_id"), "name", identity(F.lit("system"), F.col("spec_file")).alias("system_id")).distinct()
    at = named.select("spec_file", "type", "id", F.explode("locations").alias("l")).select("spec_file", "type", "id", "l.specifier", F.col("l.file").alias("path"), "l.position").filter("path is not null and position is not null")
    at = at.join(listed.select("spec_file", "path", "doc_id"), ["spec_file", "path"], "left").withColumn("doc_id", F.coalesce("doc_id", F.lit(0)).cast("bigint"))
    placed = lambda kind, key: at.filter(F.col("type") == kind).select(F.col("id").alias(key), "specifier", "doc_id", "position")
    return {"document": document, "asd_system": system, "symbol": symbol, "package": packages, "symbol_definition": placed("symbol", "symbol_id"), "package_definition": placed("package", "package_id")}


def at_home(symbols: DataFrame, home: str = "home_package") -> DataFrame:
    """The rows whose symbol is at home in the package that it was found in; imported ones go."""
    return symbols.filter(F.col(home) == F.col("package_name"))


_HEAD = re.compile(r"^[A-Za-z]+", re.M)
#: Words that are kept once for all their places.
_KNOWN = 1 << 16


def _line_heads(bodies: pa.Array) -> pa.Array:
    many, name, position, known = [0], [], array("i"), {}
    for body in bodies:  # one text at a time
        for m in _HEAD.finditer(body.as_py() or ""):
            word = m[0].upper()
            name.append(known.setdefault(word, word) if len(known) < _KNOWN else word)
            position.append(m.start())
        many.append(len(name))
    rows = pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(np.frombuffer(position, np.int32)) if name else pa.array([], pa.int32())], ["name", "position"])
    return pa.ListArray.from_arrays(pa.array(many, pa.int32()), rows)


def line_heads(documents: DataFrame) -> DataFrame:
    """(name, package_name, doc_id, position): the word of ASCII letters that begins a line,
    in upper case, defined there.  ``documents`` has doc_id, body and a column package.
    Made inside the row: no line of text is shuffled or sorted.
    """
    rows = documents.select("doc_id", F.upper("package").alias("package_name"), F.explode(F.arrow_udf(_line_heads, "array<struct<name: string, position: int>>")("body")).alias("x"))
    return rows.select("x.name", "package_name", "doc_id", "x.position")


def symbols_of(heads: DataFrame) -> DataFrame:
    """(symbol_id, name, package_name)."""
    return heads.select("name", "package_name").distinct().select(identity(F.col("package_name"), F.col("name")).alias("symbol_id"), "name", "package_name")


def symbol_definitions_of(heads: DataFrame, specifier: str = "LINE") -> DataFrame:
    return heads.select(identity(F.col("package_name"), F.col("name")).alias("symbol_id"), F.lit(specifier).alias("specifier"), "doc_id", "position")
