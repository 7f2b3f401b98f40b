"""The relations of the code-search engine, made of tables of prose.

A document's name is its source, language and number; words that begin lines are the
symbols defined there, sources the packages, and languages the systems.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identity
from ..operators import definitions, index, store
from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, body, source, lang)."""
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), F.col("text").alias("body"), "source", "lang")


def heads(docs: DataFrame) -> DataFrame:
    return definitions.line_heads(index.spread(docs.select("doc_id", "body", F.col("source").alias("package"))))


def symbol(docs: DataFrame) -> DataFrame:
    return definitions.symbols_of(heads(docs))


def symbol_definition(docs: DataFrame) -> DataFrame:
    return definitions.symbol_definitions_of(heads(docs))


def package(docs: DataFrame) -> DataFrame:
    """One for each source, in the system of the language of its first document."""
    first = docs.groupBy("source").agg(F.min(F.struct("doc_id", "lang")).alias("m"))
    return first.select(identity(F.upper("source")).alias("package_id"), F.upper("source").alias("name"), identity(F.lit("system"), F.col("m.lang")).alias("system_id"))


def package_definition(docs: DataFrame) -> DataFrame:
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return first.select(identity(F.upper("source")).alias("package_id"), F.lit("SOURCE").alias("specifier"), "doc_id", F.lit(0).alias("position"))


def asd_system(docs: DataFrame) -> DataFrame:
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"), F.count("*").cast("double").alias("analyzed_time"))
    return first.select(identity(F.lit("system"), F.col("lang")).alias("system_id"), F.col("lang").alias("name"), "doc_id", "analyzed_time")


def relations(docs: DataFrame, also: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All relations of a table (doc_id, filename, body, source, lang).  ``also``: columns that postings take along."""
    spread = index.spread(docs)
    return {
        "document": docs.select("doc_id", "filename", "body"), "token": index.dictionary(spread), "inverted_index": index.postings(spread, also=also), "symbol": symbol(docs), "package": package(docs),
        "symbol_definition": symbol_definition(docs), "package_definition": package_definition(docs), "asd_system": asd_system(docs),
    }


def sharded(docs: DataFrame) -> DataFrame:
    """``docs`` as separate indexes have them, one for each source: ``shard`` in order of
    the sources' numbers, and doc_id counted from 1 in each."""
    number = F.regexp_replace("source", "[^0-9]", "").cast("int")
    # numbers only go through the window, texts don't
    local = docs.select(F.col("doc_id").alias("old_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint").alias("local_id"))
    return docs.join(local, F.col("doc_id") == F.col("old_id")).withColumn("shard", number).withColumn("doc_id", F.col("local_id")).drop("local_id", "old_id")


def by_language(docs: DataFrame, also: Sequence[str] = ()) -> list[dict[str, DataFrame]]:
    """The relations of separate indexes, one for each language in order, each with its own ids from 1 on."""
    local = docs.select(F.col("doc_id").alias("old_id"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("bigint").alias("local_id"))
    own = docs.join(local, F.col("doc_id") == F.col("old_id")).withColumn("doc_id", F.col("local_id")).select("doc_id", "filename", "body", "source", "lang")
    # the languages there are: a handful, whatever the corpus
    return [relations(own.filter(F.col("lang").eqNullSafe(r["lang"])), also) for r in docs.select("lang").distinct().orderBy("lang").collect()]


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Where the index of the documents is stored; it is written when it is asked for first."""
    path = f"{shared_folder(spark)}/index-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if not store.exists(spark, f"{path}/done/_SUCCESS"):
        docs = document(spark, sf_dir)
        tasks = 2 * docs.rdd.getNumPartitions()
        store.write(path, {"inverted_index": index.packed(index.spread(docs))}, tasks=tasks)
        # the terms are those that have postings
        rest = relations(docs) | {"token": index.dictionary_of(store.lying(spark, path, "inverted_index"))}
        store.write(path, {n: r for n, r in rest.items() if n != "inverted_index"}, tasks=tasks)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return path


#: Documents of a system whose spec is made of them.
SPEC_DOCS = 100


def specs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(specs, sources): analyser output as the documents would have it, a system for each
    hundred of them, with a symbol for each document, and the files' texts."""
    docs = table(spark, sf_dir, "documents")
    system = F.concat(F.lit("s"), F.floor(F.col("doc_id") / SPEC_DOCS).cast("string"))
    path = F.concat(F.lit("/r/"), system, F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    identifier = F.struct(F.lit("symbol").alias("type"), F.concat(F.lit("N"), (F.col("doc_id") % 7).cast("string")).alias("name"), F.upper("lang").alias("package"))
    place = lambda file, at: F.struct(F.lit("DOC").alias("specifier"), file.alias("file"), at.cast("int").alias("position"))
    at = F.array(place(path, F.col("n_chars")), place(F.lit("/elsewhere"), F.lit(0)))
    one = F.struct("doc_id", path.alias("path"), F.struct(identifier.alias("identifier"), at.alias("locations")).alias("d"))
    each = docs.groupBy(system.alias("system_name")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    rows = each.select(
        F.col("system_name").alias("spec_file"), "system_name", F.concat(F.lit("/r/"), "system_name").alias("root_directory"), F.concat(F.lit("/r/"), "system_name", F.lit("/a.asd")).alias("asd_file"),
        F.col("x.path").alias("files"), F.col("x.d").alias("definitions"), F.lit(1.0).alias("time"),
    )
    return rows, docs.select(path.alias("filename"), F.col("text").alias("body"))
