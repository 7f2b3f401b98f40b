"""An index as a folder of Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKED, RELATIONS
from . import index as index_
from .index import absent

#: Relations that are kept in order of a column, so that a look-up reads few row groups.
ORDER = {"inverted_index": ("term", "doc_id"), "document": ("doc_id",), "token": ("term",), "symbol": ("name",), "symbol_definition": ("symbol_id",)}
#: What lies in the folders: relations as they are, and postings packed, a term's of many documents in a row.
STORED = RELATIONS | {"inverted_index": PACKED}
#: What a row is known by, when rows are added that may be there already.
KEYS = {"inverted_index": ("term", "doc_id"), "document": ("doc_id",), "token": ("term",), "symbol": ("symbol_id",), "package": ("package_id",), "asd_system": ("system_id",)}


def create(spark: SparkSession, path: str) -> None:
    """Empty relations, in place of whatever was there."""
    for name, schema in STORED.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")


def write(path: str, relations: dict[str, DataFrame], mode: str = "overwrite", tasks: int | None = None) -> None:
    """Each relation in its layout; Spark's committer shows a table whole or not at all.
    ``tasks``: how many share the work, if that are more than the session has for any query."""
    for name, rows in relations.items():
        order = ORDER.get(name)
        rows = _laid_out(name, rows)
        # ranges of the whole order: what one term or name has may be more than a task should write
        more = [tasks] if tasks and tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
        if "segment" in rows.columns:
            # ranges would have postings made twice; a file has all terms in order, so few pages of it have one
            rows = rows.repartition(*more, "term", "segment").sortWithinPartitions(*order)
        elif order:
            rows = rows.repartitionByRange(*more, *order).sortWithinPartitions(*order)
        rows.write.mode(mode).parquet(f"{path}/{name}")


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])


def _laid_out(name: str, rows: DataFrame) -> DataFrame:
    """Rows as they lie in the store; postings may be packed already."""
    if name == "inverted_index" and "data" not in rows.columns:
        rows = index_.packing(rows)
    return _shaped(rows, STORED[name])


def lying(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What lies in the store, with what was appended to it in folders of their own."""
    return spark.read.schema(STORED[name]).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")


def read_one(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A relation, with what was appended to it."""
    rows = lying(spark, path, name)
    return index_.unpacked(rows) if name == "inverted_index" else rows


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(relation, n): how many rows each relation has; packed postings are counted as they lie."""
    n = {name: F.coalesce(F.sum(F.col("n_docs").cast("bigint")), F.lit(0).cast("bigint")) if name == "inverted_index" else F.count("*") for name in RELATIONS}
    return reduce(DataFrame.unionByName, [lying(spark, path, name).agg(n[name].alias("n")).select(F.lit(name).alias("relation"), "n") for name in RELATIONS])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_part(path: str, name: str, part: str, rows: DataFrame) -> None:
    """Rows of a relation in a folder of their own, in place of what was in it: writing them again changes nothing."""
    order = ORDER.get(name)
    rows = _laid_out(name, rows)
    rows = rows.sortWithinPartitions(*order) if order else rows
    rows.write.mode("overwrite").parquet(f"{path}/{name}/{part}")


def has_part(spark: SparkSession, path: str, name: str, part: str) -> bool:
    return exists(spark, f"{path}/{name}/{part}/_SUCCESS")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: read_one(spark, path, n) for n in RELATIONS}


def attach(spark: SparkSession, path: str, prefix: str = "") -> dict[str, DataFrame]:
    """The relations of a store, also as temporary views for SQL."""
    relations = read(spark, path)
    for name, rows in relations.items():
        rows.createOrReplaceTempView(prefix + name)
    return relations


def add(spark: SparkSession, path: str, name: str, rows: DataFrame) -> None:
    """Appends the rows whose key isn't stored yet; those that are stored stay as they are."""
    write(path, {name: absent(read_one(spark, path, name), _shaped(rows, RELATIONS[name]), *KEYS[name])}, "append")
