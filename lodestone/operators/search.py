"""Search for phrases, symbols and file names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WIDTH, symbol_name, symbol_package


def _checked(phrase: str) -> str:
    if len(phrase) < WIDTH:
        raise ValueError(f"a phrase has {WIDTH} characters at least")
    return phrase


def terms_of(phrase: str) -> list[str]:
    """A phrase's trigrams, each once."""
    return sorted({phrase[k : k + WIDTH] for k in range(len(_checked(phrase)) - WIDTH + 1)})


def coalesced(spans: DataFrame, *key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end): ranges of a key that overlap or touch become one; ends are exclusive."""
    order = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def _ranges(phrase: str):
    n = len(phrase)

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def ranges(bodies: pa.Array) -> pa.Array:
        out = []
        for body in bodies.to_pylist():
            found: list[dict[str, int]] = []
            at = body.find(phrase)
            while at >= 0:
                if found and at <= found[-1]["end"]:
                    found[-1]["end"] = at + n
                else:
                    found.append({"start": at, "end": at + n})
                at = body.find(phrase, at + 1)
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return ranges


def scan_phrase(documents: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, filename, start, end) without an index: the scan keeps documents that hold
    the phrase, and their ranges, overlapping and touching matches in one, are made row by row."""
    found = documents.filter(F.col("body").contains(_checked(phrase)))
    return found.select("doc_id", "filename", F.explode(_ranges(phrase)(F.col("body"))).alias("r")).select("doc_id", "filename", "r.start", "r.end")


def _votes(rows: pa.Table, offsets: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, index of a match's document, its position) of all matches in whole documents' postings."""
    doc, row = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
    lists = rows.column("positions").combine_chunks()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    code, many = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    code, row, at = np.repeat(code, many), np.repeat(row, many), lists.flatten().to_numpy().astype(np.int64)
    # a match is known by its document and position in one number
    key = np.concatenate([(row[some] << 32) + at[some] - k for t, term in enumerate(coded.dictionary.to_pylist()) for some in [(code == t).nonzero()[0]] for k in offsets[term] for some in [some[at[some] >= k]]])
    key, n = np.unique(key, return_counts=True)
    key = key[n == sum(map(len, offsets.values()))]
    return doc, key >> 32, key & 0xFFFFFFFF


def _matches(index: DataFrame, phrase: str, made: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` says of all matches in some documents, by the index: each of the phrase's trigrams
    votes for the match it would belong to, and matches with all votes stay; a repeated trigram votes
    at each offset.  Postings of these trigrams meet by document; none becomes a row for each position."""
    offsets = {t: [k for k in range(len(phrase) - WIDTH + 1) if phrase[k : k + WIDTH] == t] for t in terms_of(phrase)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            doc = rows.column("doc_id").to_numpy()
            # the last document's postings may go on in the next batch
            whole = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            if whole:
                yield made(*_votes(rows.slice(0, whole), offsets))
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield made(*_votes(rest, offsets))

    some = index.filter(F.col("term").isin(list(offsets))).select("doc_id", "term", "positions")
    return some.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def match_positions(index: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, pos) of every match."""

    def made(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc[row], pa.int64()), pa.array(pos, pa.int32())], ["doc_id", "pos"])

    return _matches(index, phrase, made, "doc_id bigint, pos int")


def match_ranges(index: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, ranges) of documents that have matches, overlapping and touching ones in one."""
    n = len(phrase)

    def made(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(pos), bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > n)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1 if len(pos) else first
        ranges = pa.StructArray.from_arrays([pa.array(pos[first], pa.int32()), pa.array(pos[last] + n, pa.int32())], ["start", "end"])
        own = row[first]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(own)), pa.int32()), ranges)
        return pa.RecordBatch.from_arrays([pa.array(doc[own[heads]], pa.int64()), lists], ["doc_id", "ranges"])

    return _matches(index, phrase, made, "doc_id bigint, ranges array<struct<start: int, end: int>>")


def documents_with_all(index: DataFrame, phrase: str) -> DataFrame:
    """(doc_id) of documents that have all of the phrase's trigrams, wherever."""
    terms = terms_of(phrase)
    return index.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(terms)).select("doc_id")


def index_phrase(index: DataFrame, documents: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, filename, start, end), as ``scan_phrase`` gives, by the index."""
    found = match_ranges(index, phrase).join(documents.select("doc_id", "filename"), "doc_id")
    return found.select("doc_id", "filename", F.explode("ranges").alias("r")).select("doc_id", "filename", "r.start", "r.end")


def ordered(results: DataFrame) -> DataFrame:
    """Results by file name and start; equal ones by document."""
    return results.orderBy("filename", "start", "doc_id")


def files(documents: DataFrame, part: str) -> DataFrame:
    """(doc_id, filename) of documents whose name contains ``part``, letter for letter; bodies aren't read."""
    return documents.select("doc_id", "filename").filter(F.col("filename").contains(part))


def parsed_symbol(query: Column) -> Column:
    """struct<name, package_name> that a query such as ``package::name`` asks for."""
    return F.struct(symbol_name(query).alias("name"), symbol_package(query).alias("package_name"))


def symbols(symbol: DataFrame, definition: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """(doc_id, filename, start, specifier, symbol_name, package_name): the definitions of
    the symbols that a query names, in any package if it names none.  A definition in an
    unknown document stays, without a file name."""
    # constants for the optimiser, which hands them to the scan
    package = symbol_package(F.lit(query))
    mine = symbol.filter((F.col("name") == symbol_name(F.lit(query))) & (package.isNull() | (F.col("package_name") == package)))
    mine = mine.select("symbol_id", F.col("name").alias("symbol_name"), "package_name")
    at = definition.join(mine, "symbol_id").select("doc_id", F.col("position").alias("start"), "specifier", "symbol_name", "package_name")
    return at.join(documents.select("doc_id", "filename"), "doc_id", "left").select("doc_id", "filename", "start", "specifier", "symbol_name", "package_name")


def metadata(results: DataFrame) -> DataFrame:
    """(doc_id, filename, start, end, metadata): symbol results in the shape of all results."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("specifier", "symbol_name", "package_name")])
    some = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return results.select("doc_id", "filename", "start", F.col("start").alias("end"), some.alias("metadata"))
