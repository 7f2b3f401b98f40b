"""Postings of many documents at a time: found in texts, packed into bytes, and unpacked.

A packed row has a term's postings in some documents of one segment: how far each document
is from the one before, how many positions each has, then how far each position is from
the one before in its document, all of them as the codec writes numbers, compressed if
that makes them fewer bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .codec import numbers_of, varints
from .text import WIDTH


class Postings(NamedTuple):
    """Postings one after the other: ``at`` has where the positions of each begin, and their end."""

    doc: np.ndarray
    at: np.ndarray
    positions: np.ndarray


def blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, code points, length of each text) of texts that have ``most`` bytes
    together, or of one that has more.  Nulls are empty."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        some = pc.fill_null(texts[lo:hi], "")
        size = pc.utf8_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        yield lo, hi, np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), np.uint32), size
        lo = hi
    pa.default_memory_pool().release_unused()


def _order(major: np.ndarray, majors: int, minor: np.ndarray, minors: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by two numbers below the given bounds, and where a new pair begins in it."""
    bits = max(1, len(major) - 1).bit_length()
    if (majors * minors) << bits <= 1 << 64:
        # the number in order is part of what is sorted: one plain sort of numbers
        pair = (major.astype(np.uint64) * np.uint64(minors) + minor.astype(np.uint64)) << np.uint64(bits)
        pair |= np.arange(len(major), dtype=np.uint64)
        pair.sort()
        order = (pair & np.uint64((1 << bits) - 1)).astype(np.int64)
        pair >>= np.uint64(bits)
        return order, np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else order
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


class Block:
    """The trigrams of some texts."""

    def __init__(self, code: np.ndarray, size: np.ndarray, wanted: list[str] | None = None):
        top = int(code.max()) + 1 if len(code) else 0
        seen = np.zeros(top, bool)
        seen[code] = True
        self.letters = np.flatnonzero(seen)
        rank = np.zeros(top, np.uint64)
        rank[self.letters] = np.arange(len(self.letters))
        self.base = max(1, len(self.letters))
        r, base = rank[code], np.uint64(self.base)
        every = (r[:-2] * base + r[1:-1]) * base + r[2:] if len(r) >= WIDTH else np.zeros(0, np.uint64)
        known = rank if wanted is not None else None
        del r, rank
        many = np.maximum(size - (WIDTH - 1), 0)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), many)
        small = np.int32 if len(code) < 1 << 31 else np.int64
        self.pos = np.arange(len(self.row), dtype=small) - np.repeat((np.cumsum(many) - many).astype(small), many)
        self.key = every[np.repeat((np.cumsum(size) - size).astype(small), many) + self.pos]
        if wanted is not None:
            there = [[ord(c) for c in t] for t in wanted if all(ord(c) < top and seen[ord(c)] for c in t)]
            some = np.array([(int(known[a]) * self.base + int(known[b])) * self.base + int(known[c]) for a, b, c in there], np.uint64)
            keep = np.flatnonzero(np.isin(self.key, some))
            self.row, self.pos, self.key = self.row[keep], self.pos[keep], self.key[keep]
        self.rows = max(1, len(size))

    def terms(self, key: np.ndarray) -> pa.Array:
        """The trigrams that have these keys; few distinct ones."""
        distinct, back = np.unique(key, return_inverse=True)
        b = np.uint64(self.base)
        three = np.stack([distinct // (b * b), distinct // b % b, distinct % b], 1).astype(np.int64)
        text = self.letters[three].astype(np.uint32).tobytes().decode("utf-32-le")
        return pa.array([text[WIDTH * k : WIDTH * (k + 1)] for k in range(len(distinct))], pa.string()).take(pa.array(back))

    def distinct(self) -> np.ndarray:
        """The keys of the trigrams that there are."""
        return np.unique(self.key)

    def of_texts(self) -> np.ndarray:
        """The keys of each text's distinct trigrams, one text after the other."""
        order, at = _order(self.row, self.rows, self.key, self.base**3)
        return self.key[order[at]]

    def by_text(self) -> tuple[np.ndarray, np.ndarray, Postings]:
        """(row, key, postings with rows as documents), one text after the other."""
        order, at = _order(self.row, self.rows, self.key, self.base**3)
        row = self.row[order[at]]
        return row, self.key[order[at]], Postings(row, np.append(at, len(order)), self.pos[order])

    def by_term(self) -> tuple[np.ndarray, np.ndarray, Postings]:
        """The same, one term after the other."""
        order, at = _order(self.key, self.base**3, self.row, self.rows)
        row = self.row[order[at]]
        return row, self.key[order[at]], Postings(row, np.append(at, len(order)), self.pos[order])


def _steps(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How far each number is from the one before; those at ``begin`` stay."""
    out = x.astype(np.int64)
    out[1:] -= x[:-1]
    out[begin] = x[begin]
    return out


def _sums(steps: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What ``_steps`` was made of."""
    total = np.cumsum(steps)
    return total - np.repeat(total[begin] - steps[begin], many)


def _places(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of ``begin``, as many as it has."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + many, many)


#: Shorter bytes stay as they are.
_LEAST = 64


def pack(postings: Postings, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(size before compression, bytes) of rows of postings with ascending documents; ``rows``: where
    each begins, and the end.  The first document of a row isn't in them."""
    many = np.diff(postings.at)
    docs, positions = np.diff(rows), postings.at[rows]
    begin = 2 * rows + positions  # of each row, in the numbers
    numbers = np.zeros(begin[-1], np.int64)
    at = _places(begin[:-1], docs)
    step = _steps(postings.doc.astype(np.int64), rows[:-1])
    step[rows[:-1]] = 0
    numbers[at] = step
    numbers[at + np.repeat(docs, docs)] = many
    numbers[_places(begin[:-1] + 2 * docs, np.diff(positions))] = _steps(postings.positions, postings.at[:-1])
    data, end = varints(numbers)
    raw, codec, out = memoryview(data), pa.Codec("zstd", 1), []
    for a, b in pairwise(end[begin].tolist()):
        small = codec.compress(raw[a:b], asbytes=True) if b - a > _LEAST else b""
        out.append(small if 0 < len(small) < b - a else raw[a:b])
    return pa.array(np.diff(end[begin]), pa.int32()), pa.array(out, pa.binary())


def unpack(first: np.ndarray, docs: np.ndarray, size: np.ndarray, data: pa.Array) -> Postings:
    """The postings of packed rows, one row after the other."""
    codec = pa.Codec("zstd")
    whole = [x if len(x) == n else codec.decompress(x, n, asbytes=True) for x, n in zip(data.to_pylist(), size.tolist())]
    numbers, last = numbers_of(np.frombuffer(b"".join(whole), np.uint8))
    begin = np.searchsorted(last, np.append(0, np.cumsum(size, dtype=np.int64)))  # of each row, in the numbers
    docs = docs.astype(np.int64)
    at = _places(begin[:-1], docs)
    rows = np.cumsum(docs) - docs
    doc = _sums(numbers[at], rows, docs) + np.repeat(first, docs)
    many = numbers[at + np.repeat(docs, docs)]
    steps = numbers[_places(begin[:-1] + 2 * docs, np.diff(begin) - 2 * docs)]
    ends = np.append(0, np.cumsum(many))
    return Postings(doc, ends, _sums(steps, ends[:-1], many).astype(np.int32))


def reordered(postings: Postings, order: np.ndarray) -> Postings:
    many = np.diff(postings.at)[order]
    return Postings(postings.doc[order], np.append(0, np.cumsum(many)), postings.positions[_places(postings.at[:-1][order], many)])


def lists(postings: Postings, rows: np.ndarray) -> pa.Array:
    """Arrays of (doc_id, positions); ``rows``: where each begins, and the end."""
    positions = pa.ListArray.from_arrays(pa.array(postings.at.astype(np.int32)), pa.array(postings.positions, pa.int32()))
    structs = pa.StructArray.from_arrays([pa.array(postings.doc, pa.int64()), positions], ["doc_id", "positions"])
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), structs)
