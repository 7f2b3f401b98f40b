"""Document fingerprints of closed syncmers.

A k-mer of characters is selected if the least hash among its s-mers is that of its
first or its last one.  That depends on the k-mer alone, so whatever surrounds a copied
passage, the same k-mers of it are selected: anchors whose positions line up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .durable import checkpointed

#: Characters of a k-mer and of an s-mer: about 2 / (K - S + 1) of all positions are selected.
K, S = 48, 16


def _smers(code: np.ndarray, s: int) -> np.ndarray:
    """A hash of the s characters from each position on, by doubling."""
    h, have, done, out = tc.mix(code.astype(np.uint64) + np.uint64(0x9E37)), 1, 0, None
    while True:
        if s & have:
            out = h if out is None else tc.mix(out[: len(h) - done] * np.uint64(0x9FB21C651E98DF25) + h[done:])
            done += have
        have *= 2
        if have > s:
            return out[: max(0, len(code) - s + 1)]
        half = have // 2
        h = tc.mix(h[: max(0, len(h) - half)] * np.uint64(0xD6E8FEB86659FD93) + h[half:])
        if out is not None and len(h) - done < 0:
            return out[:0]


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each position on, by doubling."""
    m, have = h, 1
    while have * 2 <= w:
        m = np.minimum(m[: max(0, len(m) - have)], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: max(0, len(m) - rest)], m[rest:]) if rest else m


def syncmers(code: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers in an array of code points."""
    w = k - s + 1
    if len(code) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _smers(code, s)
    low = _window_min(h, w)
    p = np.flatnonzero((low == h[: len(low)]) | (low == h[w - 1 :]))
    g = np.zeros(len(p), np.uint64)
    for at in [*range(0, k - s, s), k - s]:
        g = g * np.uint64(0x9FB21C651E98DF25) + h[p + at]
    return p, tc.mix(g)


def _codes(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, offsets) by block of texts."""
    data, off = tc.buffers(arr)
    for a, b in tc.blocks(off):
        raw = data[off[a] : off[b]]
        lead = (raw & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(lead)])
        yield a, np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), count[off[a : b + 1] - off[a]]


def fingerprints(docs: DataFrame, k: int = K, s: int = S, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_anchors, positions, hashes) of every row, in code points of the lower-cased text.

    A null text, an empty one and any of fewer than k characters has no anchors and
    empty arrays; of equal s-mers at both ends and between, each k-mer that has the
    least at an edge is selected; a null doc_id passes through; repeated rows each give
    a row; an empty table gives an empty one; very long texts are taken whole; other
    columns are ignored.
    """
    if not 0 < s < k:
        raise ValueError("s must be positive and less than k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, code, off in _codes(batch.column(1)):
                p, g = syncmers(code, k, s)
                row = np.searchsorted(off, p, side="right") - 1
                inside = p + k <= off[row + 1]
                p, g, row = p[inside], g[inside], row[inside]
                at = np.searchsorted(row, np.arange(len(off)))
                ends = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(off) - 1), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array((p - off[row]).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64)))],
                    ["doc_id", "n_anchors", "positions", "hashes"],
                )

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lower(F.col(text)).alias("text"))
    return given.mapInArrow(run, "doc_id bigint, n_anchors int, positions array<int>, hashes array<bigint>")


#: An anchor that this share of all places has, or more, is joined by broadcast: no more than 1000 are.
HOT_SHARE = 1000


def matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(doc_a, doc_b, shift, anchors, start_a, end_a) of two tables of fingerprints: passages
    of ``left`` that occur in ``right`` ``shift`` characters further on, with ``least`` common
    anchors at least.

    Each anchor of ``left`` meets one place of ``right``, its first one by doc_id and
    position, so a passage that any number of documents share is matched with its first
    document, and the work grows with the anchors, not with their pairs.  A document
    isn't matched with itself; null doc_ids can't be named and take no part; repeated
    rows count once; documents without anchors, and empty tables, have no matches; very
    long texts are matched whole; other columns are ignored.
    """
    flat = lambda df: df.filter("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("positions", "hashes")).alias("x")).select("doc_id", F.col("x.positions").alias("at"), F.col("x.hashes").alias("hash"))
    places = flat(right)
    first = checkpointed(places.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("b"), F.count("*").alias("n")))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(first.filter(F.col("n") >= max(HOT_SHARE, total / HOT_SHARE)))
    mine = flat(left)
    met = mine.join(hot.select("hash", "b"), "hash").unionByName(mine.join(hot.select("hash"), "hash", "left_anti").join(first.select("hash", "b"), "hash"))
    pairs = met.filter(F.col("doc_id") != F.col("b.doc_id")).select(F.col("doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), (F.col("b.at") - F.col("at")).alias("shift"), "at").distinct()
    return pairs.groupBy("doc_a", "doc_b", "shift").agg(F.count("*").cast("int").alias("anchors"), F.min("at").alias("start_a"), F.max("at").alias("end_a")).filter(F.col("anchors") >= least)
