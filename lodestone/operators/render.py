"""Results as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_at


def lines(results: DataFrame, documents: DataFrame) -> DataFrame:
    """``results`` with the line of the document where each begins.  Results in unknown
    documents, or beyond a document's end, have no line and are left out; bodies are read
    for documents with results only."""
    hit = results.select("doc_id").distinct()
    bodies = documents.select("doc_id", "body").join(hit, "doc_id", "left_semi")
    found = results.join(bodies, "doc_id").filter((F.col("start") >= 0) & (F.col("start") <= F.length("body")))
    return found.withColumn("line", line_at(F.col("body"), F.col("start"))).drop("body")


def printed(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(line_text): ``filename:start:end:line`` of each result."""
    return lines(results, documents).select("doc_id", "start", F.concat_ws(":", "filename", F.col("start").cast("string"), F.col("end").cast("string"), "line").alias("line_text"))
