"""Benchmark decontamination by spaced seeds.

Fixed masks over word positions ignore some of the words they span, so a hash of the
others still matches where those were substituted.  The hashes of all benchmark
positions are joined with those of all training positions; around each hit the words
are compared along the diagonal, and what agrees well enough counts as overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc

#: 1: the word counts; 0: it may differ.  Six words each.
MASKS = ("11101011", "1100110101", "1010010111", "11011000101")
#: For items of fewer than SHORT words.  A best segment with LEAST_SEGMENT matches begins with
#: two at least and has a run of three; if no run is longer, one mismatch parts some run of three
#: from the next run.  So one of these lies in it.
SHORT_MASKS = ("1111", "11101", "10111")
SHORT = 13
#: A segment of a diagonal is kept while matches outweigh mismatches by this factor.
MISMATCH = 2.0
#: Least matching words in a segment, for it to count at all; shorter items match as a whole.
LEAST_SEGMENT = 5
#: All masks with the least and the most words of the items that they are for: those of fewer
#: than LEAST_SEGMENT words are hashed whole.
_USES = (
    *((m, SHORT, 1 << 62) for m in MASKS),
    *((m, LEAST_SEGMENT, SHORT - 1) for m in SHORT_MASKS),
    *(("1" * n, n, n) for n in range(1, LEAST_SEGMENT)),
)
#: A document is contaminated by an item from so many of the item's words on, or this share if that is less.
LEAST_WORDS, LEAST_SHARE = 12, 0.6
#: A benchmark of more characters is taken in slices of about that many, each a pass over the corpus.
SLICE_CHARS = 16_000_000


class Index:
    """Spaced-seed hashes of benchmark texts, sorted, with a bit table in front."""

    def __init__(self, ids: list, texts: list[str]):
        data, off = tc.buffers(pa.array(texts, pa.large_string()))
        h, _, _, first = tc.words(data, off)
        self.ids, self.words, self.first = ids, h, first
        size = np.diff(first)
        self.masks = [m for m, (_, least, most) in enumerate(_USES) if ((size >= least) & (size <= most)).any()]
        hashes, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in self.masks:
            mask, least, most = _USES[m]
            g = seeds(h, m)
            p = np.arange(len(g))
            i = np.searchsorted(first, p, side="right") - 1
            ok = (p + len(mask) <= first[i + 1]) & (size[i] >= least) & (size[i] <= most)
            hashes.append(g[ok])
            item.append(i[ok])
            pos.append((p - first[i])[ok])
        hashes, item, pos = (np.concatenate(x) for x in (hashes, item, pos))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.pos = hashes[order], item[order], pos[order]
        bits = min(27, max(16, int(math.log2(16 * len(hashes) + 1))))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True


def seeds(h: np.ndarray, m: int) -> np.ndarray:
    """The hash under mask ``m`` from each word on."""
    mask = _USES[m][0]
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, 0x51ED270B + m, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            g = g * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    return tc.mix(g)


def best_segment(same: np.ndarray) -> tuple[int, int]:
    """The range [a, b) with the largest sum of +1 for a match and -MISMATCH for none."""
    s = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -MISMATCH))])
    low = np.minimum.accumulate(s)
    b = int(np.argmax(s - low))
    a = int(np.argmin(s[: b + 1]))
    return a, b


def segments(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """All ranges with ``least`` matches or more: the best one, and then on both sides of it."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if np.count_nonzero(same[a:b]) < least:
            continue
        x, y = best_segment(same[a:b])
        if np.count_nonzero(same[a + x : a + y]) >= least:
            out.append((a + x, a + y))
        todo += [(a, a + x), (a + y, b)]
    return out


def _likely(hits: np.ndarray, index: Index, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``hits`` without those of short items whose diagonal has too few matches; of an item
    that matches as a whole only the first in each text stays."""
    size = np.diff(index.first)[hits[:, 1]]
    short = np.flatnonzero(size < SHORT)
    keep = np.ones(len(hits), bool)
    k = np.arange(SHORT - 1)
    for at in np.array_split(short, len(short) // 65_536 + 1):
        r, i, d = hits[at].T
        p, q = d[:, None] + k, index.first[i][:, None] + k
        inside = (k < size[at][:, None]) & (p >= first[r][:, None]) & (p < first[r + 1][:, None])
        same = inside & (h[np.where(inside, p, 0)] == index.words[np.where(inside, q, 0)])
        keep[at] = same.sum(1) >= np.minimum(LEAST_SEGMENT, size[at])
    whole = np.flatnonzero(keep & (size < LEAST_SEGMENT))
    again = (hits[whole[1:], :2] == hits[whole[:-1], :2]).all(1)
    keep[whole[1:][again]] = False
    return hits[keep]


def overlaps(arr: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, matching words, words of the item, first word in the text) of each
    text and item that overlap enough."""
    if not len(index.hashes):
        return
    data, off = tc.buffers(arr)
    for lo, hi in tc.blocks(off):
        h, _, _, first = tc.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        at, to = [], []
        for m in index.masks:
            g = seeds(h, m)
            p = np.flatnonzero(index.table[(g >> index.shift).astype(np.int64)])
            left, right = np.searchsorted(index.hashes, g[p]), np.searchsorted(index.hashes, g[p], side="right")
            many = right - left
            start = np.repeat(left - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else left, many)
            at.append(np.repeat(p, many))
            to.append(start + np.arange(len(start)))
        at, to = np.concatenate(at), np.concatenate(to)
        row = np.searchsorted(first, at, side="right") - 1
        item, diagonal = index.item[to], at - index.pos[to]
        hits = np.unique(np.stack([row, item, diagonal], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
        hits = _likely(hits, index, h, first)
        covered: dict[tuple[int, int], tuple[set[int], int]] = {}
        for r, i, d in hits.tolist():
            w = index.words[index.first[i] : index.first[i + 1]]
            a, b = max(0, first[r] - d), min(len(w), first[r + 1] - d)
            if b <= a:
                continue
            same = w[a:b] == h[d + a : d + b]
            found = segments(same, min(LEAST_SEGMENT, len(w)))
            if not found:
                continue
            good = [k + a for x, y in found for k in (np.flatnonzero(same[x:y]) + x).tolist()]
            begin = int(d + a + min(x for x, _ in found) - first[r])
            own, seen = covered.get((r, i), (set(), begin))
            covered[r, i] = (own | set(good), min(seen, begin))
        for (r, i), (own, begin) in sorted(covered.items()):
            size = int(index.first[i + 1] - index.first[i])
            if len(own) >= min(LEAST_WORDS, math.ceil(LEAST_SHARE * size)):
                yield lo + r, i, len(own), size, begin


def indexes(spark: SparkSession, benchmark: DataFrame, slice_chars: int = SLICE_CHARS, item_id: str = "item_id", text: str = "text") -> list:
    """Broadcast indexes of the benchmark, one for each slice of bounded size.

    The size is checked first: a benchmark within the bound is one broadcast, a larger
    one several that are used one after the other, so no broadcast grows with it.
    """
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.lower(text).alias("text"))
    chars = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    k = math.ceil(chars / slice_chars)
    out = []
    for part in range(k):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == part).toArrow()
        out.append(spark.sparkContext.broadcast(Index(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, matched, item_words, share, at): each document and benchmark
    item that overlap in LEAST_WORDS words, or LEAST_SHARE of a short item; ``at`` is
    the first word of the overlap in the document.

    Words are lower-cased and punctuation is ignored.  Null, empty and wordless texts
    and items have no overlap; items of fewer than LEAST_SEGMENT words match where all of
    them occur in a row; null ids pass through; repeated rows and repeated items each give
    rows, and of an item that occurs more than once in a text the first place counts; with
    an empty table on either side the result is empty; very long texts are searched
    whole.  Other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lower(F.col(text)).alias("text"))
    schema = "doc_id bigint, item_id bigint, matched int, item_words int, share double, at int"
    parts = []
    for index in indexes(spark, benchmark, slice_chars, item_id, item_text):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(overlaps(batch.column(1), index.value))
                row, item, n, size, at = (list(x) for x in zip(*found)) if found else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array([index.value.ids[i] for i in item], pa.int64()), pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array([round(a / b, 6) for a, b in zip(n, size)], pa.float64()), pa.array(at, pa.int32())],
                    ["doc_id", "item_id", "matched", "item_words", "share", "at"],
                )

        parts.append(given.mapInArrow(scan, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _clean(index):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        good = np.ones(len(texts), bool)
        good[[r for r, *_ in overlaps(texts, index.value)]] = False
        return pa.array(good)

    return clean


def clean_only(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text no benchmark item contaminates.

    Null, empty and wordless texts stay; repeated rows stay or go together; null items
    and an empty benchmark take nothing; an empty table gives an empty one; very long
    texts are searched whole; columns may have any names.
    """
    for index in indexes(docs.sparkSession, benchmark, slice_chars, item_id, item_text):
        docs = docs.filter(_clean(index)(F.lower(docs[text])))
    return docs
