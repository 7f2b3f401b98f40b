"""The positional trigram index: built, merged, checked, described, extended.

A document is one row, so grouping its terms is a matter of that row: postings are made
inside the scan, and only they, not a row for each character, are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import packed as packed_
from ..functions.text import identity, trigrams
from ..schema import PACKED, POSTING

#: Code points handled at a time: for postings a row each, and for packed ones, which are fewer rows if that is more.
_FEW, _BLOCK = 1 << 18, 1 << 20


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` in a partition for each core at least.

    A table of many files or row groups, as all large ones are, stays as it is; one that
    would be read by a few tasks only is moved once, before the work that needs the cores.
    What comes out of a shuffle is as the shuffle left it: to ask would be to run it.
    """
    if docs._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def tokenize(docs: DataFrame, text: str = "body") -> DataFrame:
    """(doc_id, pos, term): each trigram of each document."""
    return docs.select("doc_id", F.posexplode(trigrams(F.col(text))).alias("pos", "term"))


def postings(docs: DataFrame, text: str = "body", terms: Sequence[str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(term, doc_id, positions): the positions of each trigram in each document, ascending.

    doc_id is a key.  Documents shorter than a trigram, empty and null ones have none.
    ``terms``: only postings of these are made.  ``also``: columns of the document that its postings have too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, code, size in packed_.blocks(batch.column(1), _FEW):
                block = packed_.Block(code, size, None if terms is None else list(terms))
                row, key, found = block.by_text()
                if len(row):
                    at = pa.array(lo + row.astype(np.int64))
                    positions = pa.ListArray.from_arrays(pa.array(found.at.astype(np.int32)), pa.array(found.positions, pa.int32()))
                    yield pa.RecordBatch.from_arrays([block.terms(key), batch.column(0).take(at), positions, *[batch.column(2 + k).take(at) for k in range(len(also))]], ["term", "doc_id", "positions", *also])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *also)
    kinds = "".join(f", {c} {some.schema[c].dataType.simpleString()}" for c in also)
    return some.mapInArrow(run, POSTING + kinds)


#: Documents of a segment of a posting list: a frequent term's list is many rows, none of which grows with the corpus.
SEGMENT = 1 << 16
#: Positions of a packed row, if it has more than one document.
_ROW = 1024


def _rows(term: np.ndarray, found: packed_.Postings, segment: np.ndarray) -> np.ndarray:
    """Where packed rows begin, and the end, in postings in order of terms and documents."""
    part = found.at[:-1] // _ROW
    new = (term[1:] != term[:-1]) | (segment[1:] != segment[:-1]) | (part[1:] != part[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(term)]])


def _packed(terms: pa.Array, found: packed_.Postings, segment: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    size, data = packed_.pack(found, rows)
    first = rows[:-1]
    columns = [terms, pa.array(segment[first], pa.int64()), pa.array(found.doc[first], pa.int64()), pa.array(np.diff(rows), pa.int32()), size, data]
    return pa.RecordBatch.from_arrays(columns, ["term", "segment", "doc_id", "n_docs", "size", "data"])


def packed(docs: DataFrame, text: str = "body", documents: int = SEGMENT) -> DataFrame:
    """The postings of ``postings``, those of a term in many documents in one row of bytes: what
    is moved, sorted or stored is about two bytes a position, not a row a posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            if (number[1:] < number[:-1]).any():
                order = np.argsort(number, kind="stable")
                number, texts = number[order], texts.take(pa.array(order))
            for lo, _, code, size in packed_.blocks(texts, _BLOCK):
                block = packed_.Block(code, size)
                row, key, found = block.by_term()
                if len(row):
                    found = found._replace(doc=number[lo + row])
                    segment = found.doc // documents
                    rows = _rows(key, found, segment)
                    yield _packed(block.terms(key[rows[:-1]]), found, segment, rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, PACKED)


def packing(index: DataFrame, documents: int = SEGMENT) -> DataFrame:
    """Rows (term, doc_id, positions) as ``packed`` has them."""

    def one(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        term, doc, lists = (table.column(k).chunk(0) for k in range(3))
        coded = term.dictionary_encode()
        code, doc = coded.indices.to_numpy(), doc.to_numpy()
        order = np.lexsort((doc, code))
        at = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64)))
        found = packed_.reordered(packed_.Postings(doc, at, lists.flatten().to_numpy()), order)
        segment = found.doc // documents
        rows = _rows(code[order], found, segment)
        return _packed(coded.dictionary.take(pa.array(code[order][rows[:-1]])), found, segment, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                n += len(batch.column(2).flatten())
            if n >= _BLOCK:
                yield one(some)
                some, n = [], 0
        if some:
            yield one(some)

    return index.select("term", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("positions").cast("array<int>").alias("positions")).mapInArrow(run, PACKED)


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that have ``most`` bytes together, or one row that has more."""
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _unpacked(first: pa.Array, docs: pa.Array, size: pa.Array, data: pa.Array) -> pa.Array:
    a, n, b = (x.to_numpy(zero_copy_only=False) for x in (first, docs, size))
    some = [packed_.lists(packed_.unpack(a[i:j], n[i:j], b[i:j], data[i:j]), np.append(0, np.cumsum(n[i:j]))) for i, j in _slices(b, _FEW)]
    return pa.concat_arrays(some) if some else pa.array([], pa.list_(pa.struct([("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])))


def unpacked(rows: DataFrame) -> DataFrame:
    """Rows (term, doc_id, positions) of packed ones.  A filter by term goes to the scan of these."""
    return rows.select("term", F.explode(F.arrow_udf(_unpacked, codec.POSTINGS)("doc_id", "n_docs", "size", "data")).alias("p")).select("term", "p.doc_id", "p.positions")


#: What is made of some whole lists: of terms, segments, postings in order, and where each list begins, and the end.
Made = Callable[[pa.Array, pa.Array, packed_.Postings, np.ndarray], pa.RecordBatch]


def of_segments(rows: DataFrame, make: Made, schema: str, tasks: int | None = None) -> DataFrame:
    """What ``make`` says of whole lists of a term and segment, some at a time, with documents ascending.

    Packed rows meet by term and segment in order of documents, and are unpacked as they come.
    ``tasks``: how many share the work, if that are more than the session has for any query.
    """

    def made(batch: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole lists, which begin at these rows."""
        size = batch.column("size").to_numpy()
        ends = np.append(begin, batch.num_rows)
        for lo, hi in _slices(np.add.reduceat(size, begin, dtype=np.int64), _FEW):
            some = batch.slice(ends[lo], ends[hi] - ends[lo])
            first, docs = some.column("doc_id").to_numpy(), some.column("n_docs").to_numpy()
            found = packed_.unpack(first, docs, some.column("size").to_numpy(), some.column("data"))
            at = ends[lo : hi + 1] - ends[lo]
            edges = np.append(0, np.cumsum(docs, dtype=np.int64))[at]
            owner = np.repeat(np.arange(hi - lo), np.diff(edges))
            # lists of several rows whose documents lie between each other's
            if ((found.doc[1:] < found.doc[:-1]) & (owner[1:] == owner[:-1])).any():
                found = packed_.reordered(found, np.lexsort((found.doc, owner)))
            heads = pa.array(at[:-1])
            yield make(some.column("term").take(heads), some.column("segment").take(heads), found, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            segment = batch.column("segment").to_numpy()
            term = batch.column("term")
            new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (segment[1:] != segment[:-1])
            if not new.any() and len(rest) > 1 and (rest[0].column("term")[0], rest[0].column("segment")[0]) == (term[0], batch.column("segment")[0]):
                continue  # all of it belongs to the list that is open
            whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            segment, term = whole.column("segment").to_numpy(), whole.column("term")
            new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (segment[1:] != segment[:-1])
            begin = np.append(0, np.flatnonzero(new) + 1)
            if len(begin) > 1:
                yield from made(whole.slice(0, begin[-1]), begin[:-1])
            rest = [whole.slice(begin[-1])]
        if rest:
            yield from made(pa.Table.from_batches(rest).combine_chunks().to_batches()[0], np.array([0]))

    n = max(tasks or 0, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = rows.repartition(n, "term", "segment") if tasks else rows.repartition("term", "segment")
    return met.sortWithinPartitions("term", "segment", "doc_id").mapInArrow(run, schema)


def posting_segments(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(term, segment, postings): posting lists, each in segments of document numbers, as the
    byte codec takes them.  ``rows``: packed."""

    def make(term: pa.Array, segment: pa.Array, found: packed_.Postings, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([term, segment, packed_.lists(found, at)], ["term", "segment", "postings"])

    return of_segments(rows, make, f"term string, segment bigint, postings {codec.POSTINGS}", tasks)


def encoded_segments(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(term, segment, n_docs, n_bytes, back_docs, back_positions, same): what the byte codec makes of each
    segment of a posting list, and what comes back from it.  ``rows``: packed."""

    def make(term: pa.Array, segment: pa.Array, found: packed_.Postings, at: np.ndarray) -> pa.RecordBatch:
        there = packed_.lists(found, at)
        data = codec.encoded_lists(there)
        back = codec.decoded_lists(data)
        flat = back.flatten()
        row = np.repeat(np.arange(len(back)), pc.list_value_length(back).to_numpy())
        positions = np.bincount(row, pc.list_value_length(flat.field(1)).to_numpy(), len(back)).astype(np.int64)
        same = np.ones(len(back), bool) if back.equals(there) else np.array([x.equals(y) for x, y in zip(back, there)])
        columns = [term, segment, pa.array(np.diff(at), pa.int64()), pc.binary_length(data).cast(pa.int64()), pc.list_value_length(back).cast(pa.int64()), pa.array(positions), pa.array(same)]
        return pa.RecordBatch.from_arrays(columns, ["term", "segment", "n_docs", "n_bytes", "back_docs", "back_positions", "same"])

    return of_segments(rows, make, "term string, segment bigint, n_docs bigint, n_bytes bigint, back_docs bigint, back_positions bigint, same boolean", tasks)


#: Distinct terms that a task remembers to have given.
_KNOWN = 1 << 18


def _terms(docs: DataFrame, text: str) -> DataFrame:
    """(term): each trigram, mostly once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            for _, _, code, size in packed_.blocks(batch.column(0), _FEW):
                block = packed_.Block(code, size)
                new = [t for t in block.terms(block.distinct()).to_pylist() if t not in known]
                if len(known) > _KNOWN:
                    known = set()
                known.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], ["term"])

    return docs.select(text).mapInArrow(run, "term string")


def dictionary(docs: DataFrame, text: str = "body") -> DataFrame:
    """(token_id, term, kind) of every distinct trigram; kind is null."""
    return dictionary_of(_terms(docs, text))


def dictionary_of(rows: DataFrame) -> DataFrame:
    """``dictionary`` of rows that have a term, such as postings."""
    return rows.select("term").distinct().select(identity(F.col("term")).alias("token_id"), "term", F.lit(None).cast("int").alias("kind"))


def document_frequency(docs: DataFrame, text: str = "body") -> DataFrame:
    """(term, df): in how many documents a trigram is; summed in the scan first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, code, size in packed_.blocks(batch.column(0), _BLOCK):
                block = packed_.Block(code, size)
                key, many = np.unique(block.of_texts(), return_counts=True)
                yield pa.RecordBatch.from_arrays([block.terms(key), pa.array(many, pa.int64())], ["term", "n"])

    return docs.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def size(docs: DataFrame, text: str = "body") -> DataFrame:
    """(n_terms): the number of distinct trigrams."""
    return _terms(docs, text).agg(F.countDistinct("term").alias("n_terms"))


def in_order() -> Column:
    """Whether a posting list has its documents in order, and their positions too."""
    last = F.struct(F.lit(True).alias("good"), F.lit(None).cast("bigint").alias("last"))
    step = lambda a, p: F.struct((a["good"] & (a["last"].isNull() | (a["last"] <= p["doc_id"]))).alias("good"), p["doc_id"].alias("last"))
    docs_good = F.aggregate("postings", last, step, lambda a: a["good"])
    return docs_good & F.forall("postings", lambda p: p["positions"] == F.array_sort(p["positions"]))


def out_of_order(lists: DataFrame) -> DataFrame:
    """(term) of posting lists whose documents aren't in order, or whose positions aren't."""
    return lists.filter(~in_order()).select("term")


def describe(index: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, filename, doc_id, positions as text): the index for people to read."""
    names = documents.select("doc_id", "filename")
    return index.join(names, "doc_id").select("term", "filename", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


def absent(kept: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """The rows of ``new`` whose key ``kept`` lacks, one for each key: the least."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*new.columns))).filter("_n = 1").drop("_n")
    return first.join(kept.select(*key), list(key), "left_anti").select(*new.columns)


def insert_postings(kept: DataFrame, new: DataFrame, text: str = "body", tasks: int | None = None) -> DataFrame:
    """``insert_if_absent`` by term and doc_id of the postings of documents, which travel packed."""
    # whose a posting is goes with its document's number, as the last bit
    mark = lambda docs, k: docs.select((F.col("doc_id").cast("bigint") * 2 + k).alias("doc_id"), text)

    def make(term: pa.Array, segment: pa.Array, found: packed_.Postings, at: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(term)), np.diff(at))
        # those that are there come first
        there = found.doc & 1 == 1
        doc = found.doc >> 1
        order = np.lexsort((~there, doc, owner))
        doc, there, owner = doc[order], there[order], owner[order]
        again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1])])
        stays = there | ~again
        # of several new ones of a document the least stays
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))
        for k in np.flatnonzero(again & ~there & ~there[first]):
            pick = lambda x: found.positions[found.at[order[x]] : found.at[order[x] + 1]].tolist()
            if pick(k) < pick(first[k]):
                order[first[k]], order[k] = order[k], order[first[k]]
        out = packed_.reordered(found._replace(doc=found.doc >> 1), order[stays])
        positions = pa.ListArray.from_arrays(pa.array(out.at.astype(np.int32)), pa.array(out.positions, pa.int32()))
        return pa.RecordBatch.from_arrays([term.take(pa.array(owner[stays])), pa.array(out.doc, pa.int64()), positions], ["term", "doc_id", "positions"])

    return of_segments(packed(mark(kept, 1).unionByName(mark(new, 0)), text, 2 * SEGMENT), make, POSTING, tasks)


def insert_if_absent(kept: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """The rows of ``kept``, and those of ``new`` whose key it lacks, one for each key."""
    return kept.unionByName(absent(kept, new, *key))
