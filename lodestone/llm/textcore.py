"""Vectorised text primitives on Arrow string arrays: words, word hashes, blocks.

Everything here works on the concatenated UTF-8 buffer that Arrow already holds,
so there is no Python loop over words and one pass costs a few numpy operations
a byte.  Callers lower-case in the JVM first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time, in blocks of whole texts; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes whose powers and running sums are held at a time, however long a text is.
PIECE_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C55 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum()


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(which: str, n: int) -> np.ndarray:
    have = _pow[which]
    if len(have) < n:
        a = np.full(n + (n >> 2), _P if which == "p" else _PINV, np.uint64)
        a[0] = 1
        have = _pow[which] = np.cumprod(a)
    return have[:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the n + 1 offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)
    off = off[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes; a longer text is a block of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_mask(b: np.ndarray) -> np.ndarray:
    """True on bytes of words: ASCII letters and digits and all of non-ASCII but
    the punctuation of Latin-1, General Punctuation and CJK."""
    m = _WORD[b]
    for lead, seconds, width in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(b == lead)
        at = at[at + 1 < len(b)]
        at = at[np.isin(b[at + 1], seconds)]
        for k in range(width):
            m[np.minimum(at + k, len(b) - 1)] = False
    at = np.flatnonzero(b == 0xC2)
    at = at[at + 1 < len(b)]
    at = at[~np.isin(b[at + 1], (0xAA, 0xB5, 0xBA))]
    m[at] = False
    m[at + 1] = False
    return m


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): of each word its 64-bit hash and byte range, and
    of each text the index of its first word (n + 1 values)."""
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    m = word_mask(b)
    start = m.copy()
    start[1:] &= ~m[:-1]
    end = np.zeros(n + 1, bool)
    end[1:n] = m[:-1] & ~m[1:]
    end[n] = m[-1]
    edge = off[(off > 0) & (off < n)]
    cut = edge[m[edge]]
    start[cut] = True
    end[cut] |= m[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    h = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE_BYTES, side="right")))
        at, span = s[i], e[j - 1] - s[i]
        c = np.zeros(span + 1, np.uint64)
        np.cumsum(_BYTE[b[at : at + span]] * _powers("p", span), out=c[1:])
        x, y = s[i:j] - at, e[i:j] - at
        h[i:j] = mix((c[y] - c[x]) * _powers("i", span)[x] + (y - x).astype(np.uint64))
        i = j
    return h, s, e, np.searchsorted(s, off)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 run out at the end
    of the array and callers drop those that cross from one text into the next."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(g)]
    return mix(g)
