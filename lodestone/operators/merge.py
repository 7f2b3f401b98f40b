"""Several indexes made one.

Every relation comes with a column ``shard``, the order of the index that a row is from.
Documents get new ids, and whatever names a document follows.  Where each shard numbers
its documents 1, 2, ..., as an index does, new ids are the old ones moved by the sizes of
the shards before: one number a shard, and no row is shuffled for it.  Else they are
numbered anew and followed by an equi-join on (shard, doc_id).  Terms have the same id
everywhere, so tokens merge by a union of sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity
from .definitions import numbered


def together(shards: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The relations of all shards with the column ``shard``."""
    names = list(shards[0])
    return {n: reduce(DataFrame.unionByName, [s[n].withColumn("shard", F.lit(k)) for k, s in enumerate(shards)]) for n in names}


def id_map(document: DataFrame) -> DataFrame:
    """What new ids are made of; bodies aren't read.  (shard, before, n): how many documents
    the shards before have, and this one, if all shards number theirs from 1 on without a
    gap; else (shard, local_id, doc_id), the new id of each document."""
    ids = document.select("shard", F.col("doc_id").alias("local_id"))
    # one row a shard
    sizes = ids.groupBy("shard").agg(F.count("*").alias("n"), F.min("local_id").alias("a"), F.max("local_id").alias("b")).orderBy("shard").collect()
    if all((r["a"], r["b"]) == (1, r["n"]) for r in sizes):
        at, rows = 0, []
        for r in sizes:
            rows.append((r["shard"], at, r["n"]))
            at += r["n"]
        return document.sparkSession.createDataFrame(rows, "shard int, before bigint, n bigint")
    return numbered(ids, "shard", "local_id").select("shard", "local_id", F.col("doc_id").cast("bigint").alias("doc_id"))


def described(document: DataFrame, ids: DataFrame) -> DataFrame:
    """(shard, local_id, doc_id, filename): the old and new id of each document, for people to read."""
    return _moved(document.select("shard", "doc_id", "filename"), ids, "inner").select("shard", "local_id", "doc_id", "filename")


def _moved(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` with local_id and the new doc_id; null for a document that isn't there, or without such rows."""
    old = rows.withColumnRenamed("doc_id", "local_id")
    if "before" not in ids.columns:
        return old.join(ids, ["shard", "local_id"], how)
    # a number a shard
    joined = old.join(F.broadcast(ids), "shard", how)
    there: Column = (F.col("local_id") >= 1) & (F.col("local_id") <= F.col("n"))
    joined = joined.filter(there) if how == "inner" else joined
    return joined.withColumn("doc_id", F.when(there, F.col("local_id") + F.col("before")))


def documents(document: DataFrame, ids: DataFrame) -> DataFrame:
    return _moved(document, ids, "inner").select("doc_id", "filename", "body")


def tokens(token: DataFrame) -> DataFrame:
    return token.select("term").distinct().select(identity(F.col("term")).alias("token_id"), "term", F.lit(None).cast("int").alias("kind"))


def postings(index: DataFrame, ids: DataFrame) -> DataFrame:
    """A document is in one shard, so its postings need no regrouping, only the new id."""
    return _moved(index, ids, "inner").select(*[c for c in index.columns if c != "shard"])


def plain(rows: DataFrame) -> DataFrame:
    """Symbols or packages: all rows of all shards, ids unchanged."""
    return rows.drop("shard")


def pointing(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Definitions or systems, with new document ids; 0 for a document that isn't there."""
    columns = [c for c in rows.columns if c != "shard"]
    return _moved(rows, ids, "left").withColumn("doc_id", F.coalesce("doc_id", F.lit(0)).cast("bigint")).select(*columns)


def merged(shards: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """All relations of all shards as one index."""
    r = together(shards)
    ids = id_map(r["document"])
    out = {"document": documents(r["document"], ids), "token": tokens(r["token"]), "inverted_index": postings(r["inverted_index"], ids)}
    out |= {n: plain(r[n]) for n in ("symbol", "package")}
    return out | {n: pointing(r[n], ids) for n in ("symbol_definition", "package_definition", "asd_system")}
