"""A lexer for Lisp source: symbols, uninterned symbols, comments (block comments nest),
characters, function objects, strings and signs.

A token's position is where it begins, its marks included; the term of a comment, a
character, a function object or an uninterned symbol is what follows the marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOL = re.compile(r"(?:[^\s()'`,;\"|\\]++|\\.|\|(?:[^\\|]++|\\.)*\|)+", re.S)
_CHARACTER = re.compile(r"#\\(?:[A-Za-z][^\s()'`,;\"]*|.)", re.S)
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*(?:"|\\?\Z)', re.S)
_BLOCK = re.compile(r"#\||\|#")
#: What the reader dispatches on when no token of its own follows: ``#(``, ``#1=``, ``#'``, ``#+`` and so on.
_SHARP = re.compile(r"#(?:\d+[=#]|\d*[^\s\w;\"\\|)])")


def tokens(text: str) -> Iterator[tuple[str, int, str]]:
    """(term, position, kind)."""
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c.isspace():
            at += 1
        elif c == ";":
            end = text.find("\n", at)
            end = n if end < 0 else end
            yield text[at:end].lstrip(";"), at, "LINE-COMMENT"
            at = end
        elif text.startswith("#|", at):
            depth, inner, end = 0, n, n
            for m in _BLOCK.finditer(text, at):
                depth += 1 if m[0] == "#|" else -1
                if depth == 0:
                    inner, end = m.span()
                    break
            yield text[at + 2 : inner], at, "BLOCK-COMMENT"
            at = end
        elif c == '"':
            m = _STRING.match(text, at)
            yield m[0], at, "STRING"
            at = m.end()
        elif m := _CHARACTER.match(text, at):
            yield m[0][2:], at, "CHARACTER"
            at = m.end()
        elif text[at : at + 2] in ("#'", "#:") and (m := _SYMBOL.match(text, at + 2)):
            yield m[0], at, "FUNCTION-OBJECT" if text[at + 1] == "'" else "UNINTERN-SYMBOL"
            at = m.end()
        elif m := _SHARP.match(text, at):
            yield m[0], at, "T"
            at = m.end()
        elif c not in "()'`," and (m := _SYMBOL.match(text, at)):
            yield m[0], at, "SYMBOL"
            at = m.end()
        else:
            yield c, at, "T"
            at += 1


#: All of ``tokens`` but block comments as one pattern, the most frequent first; what it doesn't match is space.
_TOKEN = re.compile(
    rf"(?!#)({_SYMBOL.pattern})|;+([^\n]*)|({_STRING.pattern})|#\\([A-Za-z][^\s()'`,;\"]*|.)|#'({_SYMBOL.pattern})|#:({_SYMBOL.pattern})|({_SHARP.pattern})|({_SYMBOL.pattern})|(\S)", re.S
)
#: Kinds by the group that matched.
_KINDS = ("", "SYMBOL", "LINE-COMMENT", "STRING", "CHARACTER", "FUNCTION-OBJECT", "UNINTERN-SYMBOL", "T", "SYMBOL", "T", "BLOCK-COMMENT")
_NUMBER = {k: n for n, k in enumerate(_KINDS)}


def tokens_at_once(text: str) -> list[tuple[str, int, int]]:
    """``tokens`` in a list, several times as fast, with each one's place in ``_KINDS``."""
    if "#|" in text:
        return [(term, at, _NUMBER[kind]) for term, at, kind in tokens(text)]
    return [(m[m.lastindex], m.start(), m.lastindex) for m in _TOKEN.finditer(text)]


#: Tokens of a batch, or those of one text if it has more.
_MANY = 1 << 16


def lex(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, position, kind) of every token; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, row = batch.column(0), [], []
            for k, x in enumerate(batch.column(1)):
                some = tokens_at_once(x.as_py()) if x.is_valid else []
                rows += some
                row += [k] * len(some)
                if rows and (len(rows) >= _MANY or k == batch.num_rows - 1):
                    term, at, kind = zip(*rows)
                    kinds = pa.array(_KINDS, pa.string()).take(pa.array(kind, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(term, pa.string()), pa.array(at, pa.int32()), kinds], ["doc_id", "term", "position", "kind"])
                    rows, row = [], []

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, term string, position int, kind string")
