"""The byte codec of posting lists: big-endian groups of seven bits, the top bit set on
all but the last, absolute values throughout."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Posting = tuple[int, list[int]]


def encode_number(x: int) -> bytes:
    if x < 0:
        raise ValueError("only whole numbers from 0 on have an encoding")
    out = [x & 127]
    while x := x >> 7:
        out.append(x & 127 | 128)
    return bytes(reversed(out))


def numbers(data: bytes) -> Iterator[int]:
    """Every number in ``data``."""
    x = 0
    for b in data:
        x = x << 7 | b & 127
        if b < 128:
            yield x
            x = 0


def encode_list(xs: Iterable[int]) -> bytes:
    """How many there are, and each."""
    xs = list(xs)
    return b"".join(map(encode_number, (len(xs), *xs)))


def decode_list(data: bytes) -> list[int]:
    n, *xs = numbers(data)
    return xs[:n]


def encode_postings(postings: list[Posting], reverse: bool = True) -> bytes:
    """Count and postings, by default the last one first, so that a reader that puts each
    in front of what it has ends in ascending order."""
    some = reversed(postings) if reverse else postings
    return encode_number(len(postings)) + b"".join(encode_number(doc) + encode_list(at) for doc, at in some)


def decode_postings(data: bytes) -> list[Posting]:
    """The postings, each put in front of those before it."""
    read = numbers(data)
    out: list[Posting] = []
    for _ in range(next(read)):
        doc, n = next(read), next(read)
        out.append((doc, [next(read) for _ in range(n)]))
    return out[::-1]


def number_bytes(x: Column) -> Column:
    """The encoding's length in bytes, without making it."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(x < F.lit(1 << 7 * k), F.lit(k)).otherwise(out)
    return out.cast("int")


def list_bytes(xs: Column) -> Column:
    return number_bytes(F.size(xs)) + F.aggregate(xs, F.lit(0), lambda n, x: n + number_bytes(x.cast("bigint")))


POSTINGS = "array<struct<doc_id: bigint, positions: array<int>>>"


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The encodings of whole numbers one after the other, and where each begins (n + 1 values)."""
    if len(x) and int(x.min()) < 0:
        raise ValueError("only whole numbers from 0 on have an encoding")
    most = max(1, -(-int(x.max()).bit_length() // 7)) if len(x) else 0
    n = np.ones(len(x), np.int64)
    for k in range(1, most):
        n += x >= 1 << 7 * k
    end = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(end[-1], np.uint8)
    for k in range(most):
        some = np.flatnonzero(n > k) if k else slice(None)
        out[end[1:][some] - 1 - k] = (x[some] >> 7 * k & 127) | (128 if k else 0)
    return out, end


def numbers_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number in a row of encodings, and where each one's last byte is."""
    last = np.flatnonzero(data < 128)
    out = data[last].astype(np.int64)
    size = np.diff(last, prepend=-1)
    some, k = np.flatnonzero(size > 1), 1
    while len(some):
        out[some] |= (data[last[some] - k] & 127).astype(np.int64) << 7 * k
        k += 1
        some = some[size[some] > k]
    return out, last


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _encoded(postings: pa.Array) -> pa.Array:
    """All lists at once: their numbers in the order of the encoding, then the bytes of these."""
    rows, flat = _offsets(postings), postings.flatten()
    doc, lists = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
    at, pos = _offsets(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    many = np.diff(rows)
    # the last posting of a list comes first
    row = np.repeat(np.arange(len(many)), many)
    order = rows[:-1][row] + rows[1:][row] - 1 - np.arange(len(row))
    size = np.diff(at)[order]
    begin = np.concatenate([[0], np.cumsum(size + 2)])  # of each posting, without the counts of lists
    first = begin[rows] + np.arange(len(rows))  # of each list
    numbers_ = np.zeros(first[-1], np.int64)
    numbers_[first[:-1]] = many
    start = begin[:-1] + row + 1
    numbers_[start], numbers_[start + 1] = doc[order], size
    rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    numbers_[np.repeat(start + 2, size) + rank] = pos[np.repeat(at[:-1][order], size) + rank]
    data, end = varints(numbers_)
    out = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(end[first].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(postings.is_valid(), out, pa.scalar(None, pa.binary()))


def _decoded(data: pa.Array) -> pa.Array:
    docs, sizes_, taken, counts = [], [], [], []
    for x in data:
        if not x.is_valid:
            counts.append(0)
            continue
        n, _ = numbers_of(np.frombuffer(x.as_buffer(), np.uint8))
        head, at = [], 1
        sizes = n.tolist()
        for _ in range(sizes[0]):  # a step for each posting, not for each number
            head.append(at)
            at += 2 + sizes[at + 1]
        head = np.array(head[::-1], np.int64)
        size = n[head + 1]
        docs.append(n[head])
        taken.append(n[np.repeat(head + 2, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
        sizes_.append(size)
        counts.append(len(head))
    flat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
    inner = np.concatenate([[0], np.cumsum(flat(sizes_))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(flat(taken).astype(np.int32)))
    structs = pa.StructArray.from_arrays([pa.array(flat(docs)), lists], ["doc_id", "positions"])
    outer = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), structs, mask=data.is_null())


encoded_lists, decoded_lists = _encoded, _decoded


def encoded(postings: Column | str) -> Column:
    """The bytes of a column of posting lists."""
    return F.arrow_udf(_encoded, "binary")(postings)


def decoded(data: Column | str) -> Column:
    return F.arrow_udf(_decoded, POSTINGS)(data)
