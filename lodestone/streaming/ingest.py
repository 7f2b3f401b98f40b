"""Documents that arrive while the index is in use."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, store
from ..schema import DOCUMENT


def arriving(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(doc_id, filename, body) of Parquet files as they come to a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def ingest(documents: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each batch's documents, tokens and postings to the store ``out``, those that are
    there already left as they are.

    What is new is decided by doc_id, once a batch; postings are never compared with those
    that are stored.  A batch has folders of its own, named after the stream and its
    number, and documents are written last: one that runs again after a failure writes
    the same rows to the same place, and one that was done is left alone.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"{stream}-{number}"
        if store.has_part(spark, out, "document", part):
            return
        stored = store.read_one(spark, out, "document").select("doc_id")
        new = index.absent(stored, batch, "doc_id").persist()
        spread = index.spread(new)
        store.write_part(out, "inverted_index", part, index.packed(spread))
        if not store.has_part(spark, out, "token", part):  # else they are among the known ones
            known = store.read_one(spark, out, "token")
            store.write_part(out, "token", part, index.absent(known, index.dictionary(spread), "term"))
        store.write_part(out, "document", part, new)
        new.unpersist()

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(add).start()
