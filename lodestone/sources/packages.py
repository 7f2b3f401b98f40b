"""Package definitions in the text of Lisp files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import tokens

#: Heads of the forms that define packages, in lower case.
HEADS = frozenset(("defpackage", "cl:defpackage", "common-lisp:defpackage", "define-package", "uiop:define-package"))


def forms(text: str) -> Iterator[tuple[str, str, int]]:
    """(head, package name in upper case, position) of every package definition at top level.
    A name may be a symbol, an uninterned one, a keyword or a string."""
    depth, opened, head = 0, 0, ""
    for term, at, kind in tokens(text):
        if kind in ("LINE-COMMENT", "BLOCK-COMMENT"):
            continue
        if head:
            if kind in ("SYMBOL", "UNINTERN-SYMBOL"):
                yield head, term.lstrip(":").upper(), opened
            elif kind == "STRING":
                yield head, term[1:-1], opened
            head = ""
        if kind == "T" and term.endswith("("):
            depth += 1
            if depth == 1:
                opened = at
                last = "("
                continue
        elif kind == "T" and term == ")":
            depth = max(0, depth - 1)
        elif depth == 1 and last == "(" and kind == "SYMBOL" and term.lower() in HEADS:
            head = term.lower()
        last = term


def package_forms(docs: DataFrame, text: str = "body", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, head, name, position) of the package definitions in each text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, x in enumerate(batch.column(1).to_pylist()) for f in forms(x)]
            row, head, name, at = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(head, pa.string()), pa.array(name, pa.string()), pa.array(at, pa.int32())], ["doc_id", "head", "name", "position"])

    # the scan drops texts that can't have such a form
    some = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike("(?i)(defpackage|define-package)"))
    return some.mapInArrow(run, "doc_id bigint, head string, name string, position int")
