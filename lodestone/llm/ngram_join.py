"""Exact n-gram Jaccard self-join by grouped prefix filtering.

Two texts whose sets of word n-grams have a Jaccard similarity of t at least share L
n-grams among the first ``size - ceil(t * size) + L`` of each, in any one order.

1. ``frequencies``: how often n-grams occur, over all texts, in a row of counters.  It
   only orders n-grams, rare ones first; any order is correct.
2. ``_bundled``: texts with the same prefix and size are one group, so exact copies meet
   as one entry however many they are.  Sets of a size class that share a hash that very
   many sets have among their least ones are one group too, of BUNDLE sets or so: a
   cluster of M texts, which grows with the table, has pairs of groups by M / BUNDLE.
   Any grouping is correct, as groups stand for all prefixes of their sets.
3. ``_entries``: the groups' prefixes.  Entries travel packed, a few hundred to a row.
   Groups that share L prefix n-grams and whose sizes allow t are candidates, found in
   one shuffle by n-gram, one sorted sweep over each partition and one sum.
4. ``_verified``: each set of a candidate travels once to the least neighbour of a clique
   of groups, not once for each pair, and intersections are counted exactly, those of
   large groups as products of matrices.  Where many sets meet at one neighbour they are
   spread over blocks of bounded size, and each pair is checked in one block.
5. A block answers with a row a set: how many rows it is similar to there, and the least
   set that it is connected with.  So links are counted one by one, but neither pairs of
   copies nor pairs of sets ever travel.

An n-gram is 54 bits, its size class and 46 of its hash, which leaves ten bits for the
row: one sort of a block orders all its sets.  Sets are known by 64-bit signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .durable import checkpointed

#: Words in an n-gram, and the similarity from which on documents are near duplicates.
N, THRESHOLD = 3, 0.5
#: L: n-grams that the prefixes of a candidate pair share at least, where the sets are that large.
SHARED = 8
#: log2 of the counters of n-grams; a fixed size.  What many documents share stands out of
#: the even load of the rest at any size of the corpus.
WIDTH = 22
#: Rows of a block: ten bits.
ROWS = 1024
_LOW, _HASH = np.uint64((1 << 54) - 1), np.uint64((1 << 46) - 1)
#: Up to so many group keys are broadcast to pick the sets to verify; more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
#: Up to so many rows to drop are broadcast; more are joined by shuffle.
DROP_ROWS = 1_000_000
#: Prefix n-grams that one task sweeps.
SWEEP_ROWS = 3_000_000
#: Prefix n-grams that are packed, and swept, at a time.
AT_ONCE = 1 << 19
#: n-grams of the sets, and sets, that meet in one block of a neighbour; a block holds about twice as many.
BLOCK_GRAMS, BLOCK_SETS = 1 << 20, 1024
#: A set that this share of all rows has, or more, is joined by broadcast: no more than 1000 sets are.
HOT_SHARE = 1000
#: A prefix n-gram as it travels, in the bucket of its upper 14 bits: the others, the group in 40 bits, and the size, up to a limit.
_ENTRY = np.dtype([("gram", "<u4"), ("g", "<u4"), ("top", "u1"), ("size", "<u2")])
_MOST = 65535
#: Pairs that one sweep step holds at most.
STEP = 1 << 18
#: Least hashes of a set, two bits of each say which; sets that must have one for it to make bundles; sets in a bundle, about; the most such hashes.
MINS, HOT_SETS, BUNDLE, HOT_MOST = 4, 32, 128, 1 << 20
#: Size classes of bundles, a quarter of a power of two, and the least and most of each size's class.
_CLASS = np.floor(np.log2(np.maximum(1, np.arange(_MOST + 1))) * 4).astype(np.int64)
_MINS = [f"m{k}" for k in range(MINS)]
_LOWER, _UPPER = np.searchsorted(_CLASS, _CLASS), np.searchsorted(_CLASS, _CLASS, side="right") - 1
#: Pairs of sets up to which they are compared one by one, and numbers that a matrix of a block holds.
FEW_PAIRS, MATRIX = 64, 1 << 22


def prefix_length(size: np.ndarray, t: float, shared: int = SHARED) -> np.ndarray:
    return np.minimum(size, size - np.ceil(size * t - 1e-9).astype(np.int64) + shared)


def sets(arr: pa.Array, n: int, often: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, n-grams) by block: row k of the block has the different
    n-grams [offsets[k], offsets[k + 1]), rare ones first.  A text of fewer than n
    words, but one at least, has the hash of all its words as its only n-gram."""
    data, off = tc.buffers(arr)
    shift = np.uint64(64 - WIDTH)
    for lo, hi in tc.blocks(off):
        for a in range(lo, hi, ROWS):
            b = min(hi, a + ROWS)
            h, _, _, first = tc.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            count = np.diff(first)
            row = np.repeat(np.arange(b - a, dtype=np.uint64), count)
            g = tc.ngrams(h, n)
            rarity = often[(g >> shift).astype(np.int64)].astype(np.uint64)
            key = (row[: len(g)] << np.uint64(54)) | (rarity << np.uint64(46)) | (g >> np.uint64(18) & _HASH)
            key = key[row[: len(g)] == row[n - 1 : n - 1 + len(g)]]
            short = np.flatnonzero((count > 0) & (count < n))
            if len(short):
                whole = [tc.mix(np.bitwise_xor.reduce(tc.mix(h[first[k] : first[k + 1]] + np.arange(count[k], dtype=np.uint64)), keepdims=True))[0] for k in short]
                key = np.concatenate([key, (short.astype(np.uint64) << np.uint64(54)) | (np.array(whole, np.uint64) >> np.uint64(18) & _HASH)])
            key.sort()
            if len(key):
                keep = np.ones(len(key), bool)
                keep[1:] = key[1:] != key[:-1]
                key = key[keep]
            yield a, np.searchsorted(key, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(54)), key & _LOW


def _signature(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's n-grams, whatever their order."""
    c = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(tc.mix(g ^ np.uint64(0xA5A5A5A5DEADBEEF)), out=c[1:])
    return tc.mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(np.uint64))


def frequencies(texts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A size class from 0 to 255 for each of 2**WIDTH counters of all texts' n-grams, and
    the number of n-grams.

    Each task counts in its own row, cut in slices that are summed by slice; the sum,
    of a fixed size, comes to the driver.
    """
    slices, shift = 64, np.uint64(64 - WIDTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = np.zeros(1 << WIDTH, np.uint8), 0
        for batch in batches:
            data, off = tc.buffers(batch.column(0))
            for a, b in tc.blocks(off):
                g = tc.ngrams(tc.words(data[off[a] : off[b]], off[a : b + 1] - off[a])[0], n)
                at, k = np.unique((g >> shift).astype(np.uint32), return_counts=True)
                mine[at] = np.minimum(255, mine[at] + k)
                seen += len(g)
        if seen:
            counts = pa.array([x.tobytes() for x in np.split(mine, slices)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), counts, pa.array([seen] + [0] * (slices - 1), pa.int64())], ["slice", "counts", "seen"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((1 << WIDTH) // slices, np.int64), 0
        for batch in batches:
            seen += pc.sum(batch.column(2)).as_py() or 0
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), np.uint8)
        # the order needs no more than the size of a count: an eighth of a power of two
        classes = np.minimum(255, np.log2(total + 1) * 8).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([classes], pa.binary()), pa.array([seen], pa.int64())], ["slice", "counts", "seen"])

    schema = "slice int, counts binary, seen bigint"
    rows = texts.mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).toArrow().to_pylist()
    out = np.zeros((slices, (1 << WIDTH) // slices), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1), sum(r["seen"] for r in rows)


def _least(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MINS hashes of each row's n-grams, the least of each quarter of them; 0 where there is none."""
    h, out = g << np.uint64(18), np.zeros((len(off) - 1, MINS), np.uint64)
    quarter = (h >> np.uint64(62)).astype(np.uint8)
    for k in range(MINS):
        at = np.flatnonzero(quarter == k)
        edge = np.searchsorted(at, off)
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if len(some):
            out[some, k] = np.minimum.reduceat(h[at], edge[some])
    return out.view(np.int64)


def _bundled(key: np.ndarray, sig: np.ndarray, size: np.ndarray, least: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Group keys, 40 bits: of sets with one of the hot hashes, (hashes in order, sets that
    have them), an odd one by the hash that most have, size class and part; else the key."""
    hashes, many = hot
    if not len(hashes):
        return key
    at = np.minimum(np.searchsorted(hashes, least), len(hashes) - 1)
    have = np.where(hashes[at] == least, many[at], 0)
    best = have.argmax(axis=1)[:, None]
    have, least = np.take_along_axis(have, best, 1)[:, 0], np.take_along_axis(least, best, 1)[:, 0]
    part = tc.mix(sig.astype(np.uint64)) % np.maximum(1, -(-have // BUNDLE)).astype(np.uint64)
    kind = part << np.uint64(8) | _CLASS[np.minimum(size, _MOST)].astype(np.uint64)
    bundle = tc.mix(least.astype(np.uint64) ^ tc.mix(kind)) >> np.uint64(24) | np.uint64(1)
    return np.where((have > 0) & (size > 0), bundle, key)


def _grouped(arr: pa.Array, n: int, t: float, often: np.ndarray, hot: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: first row; of each row the size, group key (40 bits, even without hot
    hashes; groups that share one are only verified together) and set signature; the rows'
    n-grams and their offsets; the prefixes' n-grams and their offsets."""
    for a, off, g in sets(arr, n, often):
        size = np.diff(off)
        rank = np.arange(len(g)) - np.repeat(off[:-1], size)
        length = np.where(size > 0, prefix_length(size, t), 0)
        p = g[rank < np.repeat(length, size)]
        poff = np.concatenate([[0], np.cumsum(length)])
        key = (_signature(p, poff) ^ tc.mix(size.astype(np.uint64))) >> np.uint64(25) << np.uint64(1)
        sig = _signature(g, off)
        if hot is not None:
            key = _bundled(key, sig, size, _least(g, off), hot)
        yield a, size, key, sig, g, off, p, poff


def _binaries(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Row k holds the bytes of data[off[k] : off[k + 1]]; no Python object a row."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _entries(texts: DataFrame, n: int, t: float, often, hot) -> DataFrame:
    """(bucket, entries): the prefixes' n-grams with group and size, a bundle's the least of its class, packed by bucket."""

    def pack(key: list[np.ndarray], groups: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        g, first, no = np.unique(np.concatenate(groups), return_index=True, return_inverse=True)
        size, k, low = np.concatenate(sizes)[first], np.concatenate(key), np.uint64((1 << 18) - 1)
        k = np.unique(k & ~low | no[(k & low).astype(np.int64)].astype(np.uint64))
        at = (k & low).astype(np.int64)
        e = np.empty(len(k), _ENTRY)
        e["gram"] = (k >> np.uint64(18)).astype(np.uint32)
        e["g"], e["top"], e["size"] = g[at] & np.uint64(0xFFFFFFFF), g[at] >> np.uint64(32), size[at]
        bucket = (k >> np.uint64(50)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), _binaries(e, np.append(begin, len(e))).cast(pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, sizes, rows, held = [], [], [], 0, 0
        for batch in batches:
            for _, size, g, sig, _, _, p, poff in _grouped(batch.column(0), n, t, often.value, hot.value):
                bundle = g & np.uint64(1) > 0
                some = np.unique(np.where(bundle, sig, g), return_index=True)[1]
                size = np.minimum(size, _MOST)
                size = np.where(bundle, _LOWER[size], size)
                some = some[size[some] > 0]
                no = np.full(len(size), -1, np.int64)
                no[some] = np.arange(len(some)) + rows
                row = np.repeat(no, np.diff(poff))
                p, row = p[row >= 0], row[row >= 0]
                key.append((p & _HASH) << np.uint64(18) | row.astype(np.uint64))  # the size class has done its work
                groups.append(g[some])
                sizes.append(size[some])
                rows, held = rows + len(some), held + len(p)
                if held and (held >= AT_ONCE or rows > (1 << 18) - ROWS):
                    yield pack(key, groups, sizes)
                    key, groups, sizes, rows, held = [], [], [], 0, 0
        if held:
            yield pack(key, groups, sizes)

    return texts.mapInArrow(run, "bucket int, entries binary")


def _pairs_of_runs(gram: np.ndarray, g: np.ndarray, size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(g1, g2, k), g1 < g2: pairs of different groups in runs of equal n-grams whose sizes
    allow t.  k is 1, or more where the sets are too small to share SHARED n-grams.  The
    arrays are ordered by n-gram, then size; the sets of a bundle may be larger, up to
    the end of its class."""
    if not len(gram):
        return
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    run = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(gram))[run]
    # in a run the partners of k are those after it, up to the size that is too large
    key = run.astype(np.int64) * (1 << 32)
    most = np.where(g & 1 > 0, _UPPER[size], size)
    last = np.minimum(end, np.searchsorted(key + size, key + np.minimum(_MOST, np.floor(most / t + 1e-9)).astype(np.int64), side="right"))
    many = np.maximum(last - np.arange(len(gram)) - 1, 0)
    total = np.cumsum(many)
    a = 0
    while a < len(gram):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + STEP, side="right")))
        k = np.repeat(np.arange(a, b), many[a:b])
        if len(k):
            j = k + 1 + np.arange(len(k)) - np.repeat(total[a:b] - many[a:b] - before, many[a:b])
            differ = g[k] != g[j]
            k, j = k[differ], j[differ]
            need = np.minimum(SHARED, np.ceil((size[k].astype(np.int64) + size[j]) * (t / (1 + t)) - 1e-9)).astype(np.int64)
            yield np.minimum(g[k], g[j]), np.maximum(g[k], g[j]), SHARED + 1 - need
        a = b


def _candidates(entries: DataFrame, t: float, tasks: int) -> DataFrame:
    """(g1, g2) of groups that share enough prefix n-grams; g1 = g2 isn't among them."""

    def out(gram: np.ndarray, g: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(gram, kind="stable")
        gram, g, size = gram[order], g[order], size[order]
        lone = np.ones(len(gram), bool)
        same = gram[1:] == gram[:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        gram, g, size = gram[~lone], g[~lone], size[~lone]
        if not len(gram):
            return
        order = np.lexsort((g, size, gram))
        gram, g, size = gram[order], g[order], size[order]
        once = np.ones(len(gram), bool)  # copies in one run are one entry
        once[1:] = (gram[1:] != gram[:-1]) | (g[1:] != g[:-1])
        for x, y, k in _pairs_of_runs(gram[once], g[once], size[once], t):
            x, y, k = _summed(x, y, k)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(k.astype(np.int32))], ["g1", "g2", "k"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        data, off = tc.buffers(batch.column(1))
        e = data.view(_ENTRY)
        bucket = np.repeat(batch.column(0).to_numpy().astype(np.uint64), np.diff(off) // _ENTRY.itemsize)
        return [bucket << np.uint64(32) | e["gram"], e["g"].astype(np.int64) | e["top"].astype(np.int64) << 32, e["size"].astype(np.int64)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, AT_ONCE
        for batch in batches:
            held.append(columns(batch))
            rows += len(held[-1][0])
            if rows >= enough:
                gram, g, size = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(gram >> np.uint64(32), gram[-1] >> np.uint64(32)))
                if cut:
                    yield from out(gram[:cut], g[:cut], size[:cut])
                else:  # one bucket fills it: each group is needed once for each n-gram
                    order = np.lexsort((g, gram))
                    gram, g, size = gram[order], g[order], size[order]
                    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (g[1:] != g[:-1])])
                    gram, g, size = gram[new], g[new], size[new]
                held, rows = [[gram[cut:], g[cut:], size[cut:]]], len(gram) - cut
                enough = max(AT_ONCE, 2 * rows)
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held)))

    placed = entries.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    pairs = placed.mapInArrow(sweep, "g1 bigint, g2 bigint, k int")
    return pairs.groupBy("g1", "g2").agg(F.sum("k").alias("k")).filter(F.col("k") >= SHARED).select("g1", "g2")


def _summed(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y, k = x[order], y[order], k[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(first)
    return x[at], y[at], np.add.reduceat(k, at) if len(at) else k


def _members(docs: DataFrame, n: int, t: float, often) -> DataFrame:
    """(doc_id, t, g, sig, size, least hashes) of each row of (text, doc_id, t); a text without n-grams has no g and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, size, key, sig, g, off, _, _ in _grouped(batch.column(0), n, t, often.value):
                none, least = size == 0, _least(g, off)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, len(size)) for c in batch.columns[1:]] + [pa.array(key.view(np.int64), mask=none), pa.array(sig.view(np.int64), mask=none), pa.array(size.astype(np.int32)), *map(pa.array, least.T)],
                    ["doc_id", "t", "g", "sig", "size", *_MINS],
                )

    return docs.mapInArrow(run, "doc_id bigint, t bigint, g bigint, sig bigint, size int, " + ", ".join(f"{m} bigint" for m in _MINS))


def _hot(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that HOT_SETS different sets or more have among their least ones, in order, and how many."""
    each = members.filter("sig is not null").groupBy("sig").agg(*[F.max(m).alias(m) for m in _MINS]).select(F.explode(F.array(*_MINS)).alias("m"))
    rows = each.filter("m <> 0").groupBy("m").agg(F.count("*").alias("k")).filter(F.col("k") >= HOT_SETS).orderBy(F.desc("k"), "m").limit(HOT_MOST).toArrow()
    hashes, many = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], many[order]


def _named(members: DataFrame, hot) -> DataFrame:
    """(g, sig, size, copies, first) of each different set, with its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dict(zip(batch.schema.names, batch.columns))
            least = np.stack([x[m].to_numpy() for m in _MINS], axis=1)
            g = _bundled(x["g"].to_numpy().view(np.uint64), x["sig"].to_numpy(), x["size"].to_numpy(), least, hot.value)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *[x[c] for c in ("sig", "size", "copies", "first")]], ["g", "sig", "size", "copies", "first"])

    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    each = members.filter("sig is not null").groupBy("g", "sig").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.min(row).alias("first"), *[F.max(m).alias(m) for m in _MINS])
    return each.mapInArrow(run, "g bigint, sig bigint, size int, copies bigint not null, first struct<n: boolean, doc_id: bigint, t: bigint>")


def _sets_of(texts: DataFrame, n: int, t: float, often, hot, wanted) -> DataFrame:
    """(g, sig, grams): the whole sets, of the groups in ``wanted`` or of all; once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = wanted.value if wanted else None, np.zeros(0, np.int64)
        for batch in batches:
            for _, size, key, sig, g, off, _, _ in _grouped(batch.column(0), n, t, often.value, hot.value):
                key, sig = key.view(np.int64), sig.view(np.int64)
                some = np.unique(sig, return_index=True)[1]
                some = some[size[some] > 0]
                if keys is not None and len(some):
                    at = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
                    some = some[keys[at] == key[some]] if len(keys) else some[:0]
                if len(some):
                    at = np.searchsorted(seen, sig[some])
                    known = at < len(seen)
                    known[known] = seen[at[known]] == sig[some][known]
                    some, at = some[~known], at[~known]
                    seen = np.insert(seen, at, sig[some])
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(sig[some]), _binaries(g, off).take(pa.array(some)).cast(pa.binary())], ["g", "sig", "grams"])

    return texts.mapInArrow(run, "g bigint, sig bigint, grams binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.lower(F.col(text)).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"))


def _similar(docs: DataFrame, n: int, t: float, broadcast_keys: int, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, names, found) of a table (lower-cased text, doc_id, t): members
    (doc_id, t, g, sig, size) of all rows, names (g, sig, size, copies, first) of all
    different sets, and what ``_verified`` finds."""
    spark = docs.sparkSession
    texts = docs.select("text")
    classes, seen = frequencies(texts, n)
    often = spark.sparkContext.broadcast(classes)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(seen * (1 - t) / SWEEP_ROWS))
    members = checkpointed(_members(docs, n, t, often))
    hot = spark.sparkContext.broadcast(_hot(members))
    names = checkpointed(_named(members, hot))
    groups = names.groupBy("g").agg(F.count("*").alias("k"), F.sum("size").alias("n"))
    between = _candidates(_entries(texts, n, t, often, hot), t, tasks)
    candidates = checkpointed(between.unionByName(groups.filter("k > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))))
    wanted_keys = candidates.select(F.explode(F.array("g1", "g2")).alias("g")).distinct()
    few = wanted_keys.count() <= broadcast_keys
    wanted = spark.sparkContext.broadcast(np.sort(wanted_keys.toArrow().column(0).to_numpy())) if few else None
    sets_ = _sets_of(texts, n, t, often, hot, wanted)
    if not few:
        sets_ = sets_.join(wanted_keys, "g", "left_semi")
    # a group too large for a block is several units; most are one
    split = checkpointed(groups.select("g", F.ceil(F.greatest(F.col("n") / BLOCK_GRAMS, F.col("k") / BLOCK_SETS)).alias("pieces")).filter("pieces > 1"))
    unit = lambda g, pieces, k: F.when(pieces.isNull(), g).otherwise(F.xxhash64(g, k.cast("bigint")))
    units = names.join(split, "g", "left").select(unit(F.col("g"), F.col("pieces"), F.pmod(F.hash("sig"), F.col("pieces"))).alias("u"), "sig", "size", "copies")
    pieces = lambda k: split.select(F.col("g").alias(f"g{k}"), F.col("pieces").alias(f"p{k}"))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"p{k}", F.lit(1)) - 1)).alias(f"k{k}")
    meet = candidates.join(pieces(1), "g1", "left").join(pieces(2), "g2", "left").select("*", each(1)).select("*", each(2)).filter("g1 <> g2 or k1 <= k2")
    meet = meet.select(*[unit(F.col(f"g{k}"), F.col(f"p{k}"), F.col(f"k{k}")).alias(f"u{k}") for k in (1, 2)])
    meet = meet.select(F.least("u1", "u2").alias("s1"), F.greatest("u1", "u2").alias("s2"))
    return members.drop(*_MINS), names, _verified(meet, units, sets_.groupBy("sig").agg(F.first("grams").alias("grams")), t, pairs)


def _merge(label: np.ndarray, at: np.ndarray) -> None:
    """The rows ``at`` and all that have the label of one of them get the least of these."""
    some = np.unique(label[at])
    if len(some) > 1:
        label[np.isin(label, some)] = some[0]


class _Block:
    """Sets that meet in a block, with n-grams and copies, in the order of their signatures."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, int]]) -> None:
        rows.sort(key=lambda r: r[1])
        self.sig, self.grams = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
        self.copies, self.size = np.array([r[3] for r in rows], np.int64), np.array([len(r[2]) for r in rows], np.int64)
        self.of: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            self.of.setdefault(r[0], []).append(k)
        self._known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _columns(self, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A unit's n-grams, and for each one of each of its sets which one it is, and of which set."""
        if u not in self._known:
            own = self.of[u]
            grams, which = np.unique(np.concatenate([self.grams[k] for k in own]), return_inverse=True)
            self._known[u] = grams, which.astype(np.int32), np.repeat(np.arange(len(own), dtype=np.int32), self.size[own])
        return self._known[u]

    def overlaps(self, u: int, v: int) -> np.ndarray:
        """Common n-grams of each set of u and each of v."""
        a, b = self.of[u], self.of[v]
        if len(a) * len(b) <= FEW_PAIRS:
            return np.array([[_overlap(self.grams[x], self.grams[y]) for y in b] for x in a], np.int64).reshape(len(a), len(b))
        out = np.zeros((len(a), len(b)), np.int64)
        (x, ix, rx), (y, iy, ry) = self._columns(u), self._columns(v)
        _, px, py = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        cx, cy = np.full(len(x), -1, np.int64), np.full(len(y), -1, np.int64)
        cx[px] = cy[py] = np.arange(len(px))
        cx, cy = cx[ix], cy[iy]
        wide = max(1, MATRIX // (len(a) + len(b)))  # float32 counts exactly up to 2**24
        for lo in range(0, len(px), wide):
            m = [np.zeros((k, min(wide, len(px) - lo)), np.float32) for k in (len(a), len(b))]
            for z, c, r in zip(m, (cx, cy), (rx, ry)):
                here = (c >= lo) & (c < lo + wide)
                z[r[here], c[here] - lo] = 1
            out += (m[0] @ m[1].T).astype(np.int64)
        return out


def _verified(meet: DataFrame, units: DataFrame, sets_: DataFrame, t: float, pairs: bool) -> DataFrame:
    """Of the pairs (s1, s2), s1 <= s2, of units (u, sig, size, copies), the pairs of their
    sets (sig, grams) at a similarity of t at least: (s1, s2, overlap, size1, size2), or a
    row (sig, links, root) for each set and block with the rows that it is similar to and
    the least set that it is connected with there.

    A pair of units is checked at the least neighbour of its lesser one, where the sets of
    all pairs that meet there come once each, ahead of the pairs.  A neighbour where many
    meet is several blocks: its units fall in parts, and each two parts are a block.
    """

    def block(rows: list[tuple], todo: list[tuple[int, int]]) -> list[tuple]:
        here, found = _Block(rows), []
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for u, v in todo:
            a, b = np.array(here.of[u]), np.array(here.of[v])
            if u == v and len(a) < 2:
                continue
            o = here.overlaps(u, v)
            good = o >= t * (here.size[a][:, None] + here.size[b] - o) - 1e-9
            if u == v:
                good = np.triu(good, 1)
            if not good.any():
                continue
            if pairs:
                for x, y in zip(*np.nonzero(good)):
                    p, q = sorted((a[x], b[y]))
                    found.append((here.sig[p], here.sig[q], o[x, y], here.size[p], here.size[q]))
                continue
            np.add.at(links, a, good @ here.copies[b])
            np.add.at(links, b, here.copies[a] @ good)
            for x in np.flatnonzero(good.any(axis=1)):
                _merge(label, np.append(b[good[x]], a[x]))
        return found if pairs else [(here.sig[k], links[k], here.sig[label[k]]) for k in np.flatnonzero(links)]

    kinds = [pa.int64()] * 2 + [pa.int32()] * 3 if pairs else [pa.int64()] * 3
    names = ["s1", "s2", "overlap", "size1", "size2"] if pairs else ["sig", "links", "root"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, todo, rows = None, [], [], []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names)

        for batch in batches:
            grams = batch.column(6)
            for k, (*own, x, y, sig, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5, 7)))):
                if own != at:
                    rows += block(here, todo)
                    at, here, todo = own, [], []
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
                if y is None:
                    here.append((x, sig, np.frombuffer(grams[k].as_py(), np.uint64), copies))
                else:
                    todo.append((x, y))
        rows += block(here, todo)
        if rows:
            yield flush(rows)

    near = meet.select(F.col("s1").alias("s"), F.col("s2").alias("o")).unionByName(meet.select(F.col("s2").alias("s"), F.col("s1").alias("o")))
    least = near.groupBy("s").agg(F.least("s", F.min("o")).alias("home")).withColumnRenamed("s", "s1")
    homed = checkpointed(meet.join(least, "s1").select("home", "s1", "s2"))
    sized = units.groupBy(F.col("u").alias("s")).agg(F.count("*").alias("k"), F.sum("size").alias("n"))
    there = homed.select("home", F.explode(F.array("s1", "s2")).alias("s")).distinct().join(sized, "s")
    parts = there.groupBy("home").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_GRAMS, F.sum("k") / BLOCK_SETS)).cast("int").alias("parts"))
    part = lambda s: F.pmod(F.hash(s), F.col("parts"))
    placed = homed.join(parts, "home").select("home", F.least(part("s1"), part("s2")).alias("i"), F.greatest(part("s1"), part("s2")).alias("j"), "s1", "s2")
    travel = placed.select("home", "i", "j", F.explode(F.array("s1", "s2")).alias("u")).distinct().join(units.select("u", "sig", "copies"), "u").join(sets_, "sig")
    none = F.lit(None)
    rows = travel.select("home", "i", "j", F.col("u").alias("x"), none.cast("bigint").alias("y"), "sig", "grams", "copies")
    rows = rows.unionByName(placed.select("home", "i", "j", F.col("s1").alias("x"), F.col("s2").alias("y"), none.cast("bigint").alias("sig"), none.cast("binary").alias("grams"), none.cast("bigint").alias("copies")))
    schema = "s1 bigint, s2 bigint, overlap int, size1 int, size2 int" if pairs else "sig bigint, links bigint, root bigint"
    return rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", F.col("y").asc_nulls_first()).mapInArrow(check, schema)


def pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set) of every row, and (set_a, set_b, jaccard) of all pairs set_a < set_b of
    different sets of n-grams with a similarity of t at least.

    Documents with the same set are copies of each other.  A null text, an empty one or
    one without words has a null set and no partner; null doc_ids pass through; repeated
    rows each give a row; very long texts are taken whole; an empty table gives empty
    ones.  Other columns are ignored.
    """
    members, _, found = _similar(_keyed(docs, text, doc_id), n, t, broadcast_keys, True)
    jaccard = F.round(F.col("overlap") / (F.col("size1") + F.col("size2") - F.col("overlap")), 6)
    return members.select("doc_id", F.col("sig").alias("set")), found.select(F.col("s1").alias("set_a"), F.col("s2").alias("set_b"), jaccard.alias("jaccard"))


def _classed(docs: DataFrame, n: int, t: float, broadcast_keys: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): the rows of a table (lower-cased text, doc_id, t), and of each
    different set (sig, n_links, first): the other rows that are similar to one that has it,
    and the first row of its class."""
    members, names, found = _similar(docs, n, t, broadcast_keys)
    tied = checkpointed(found)
    root = clusters(tied.filter("sig <> root").select("sig", "root"), "sig", "root")
    links = tied.groupBy(F.col("sig").alias("tied_sig")).agg(F.sum("links").alias("links"))
    sets_ = names.join(links, names["sig"] == links["tied_sig"], "left").join(root, names["sig"] == root["node"], "left")
    sets_ = checkpointed(sets_.select("sig", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "sig").alias("root"), "first"))
    first = sets_.groupBy("root").agg(F.min("first").alias("first"))
    return members, sets_.drop("first").join(first, "root").select("sig", "copies", "n_links", "first")


def _with_sets(members: DataFrame, sets_: DataFrame) -> DataFrame:
    """Rows with what is known of their sets; sets that very many rows have come by broadcast."""
    sets_ = checkpointed(sets_)
    least = max(HOT_SHARE, members.count() / HOT_SHARE)
    hot = F.broadcast(sets_.filter(F.col("copies") >= least))
    rest = members.join(hot.select("sig"), "sig", "left_anti").join(sets_, "sig")
    return members.join(hot, "sig").unionByName(rest)


def near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least doc_id of its class, and the
    number of other rows at a similarity of t at least, exact copies and others.

    A class is a connected component of such pairs.  Words are lower-cased.  A text of
    fewer than n words has one n-gram, all of it; a null text, an empty one or one without
    words has none, no links and a class of its own.  A null doc_id passes through, and is
    a class's id only if all its doc_ids are null; repeated rows are copies, each with a
    row; very long texts are taken whole; an empty table gives an empty result.  Other
    columns are ignored.
    """
    members, sets_ = _classed(_keyed(docs, text, doc_id), n, t, broadcast_keys)
    alone = members.filter("sig is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return _with_sets(members.filter("sig is not null"), sets_).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links").unionByName(alone)


def clusters(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each connected component of an undirected graph.

    Each round, every node takes the least label among itself and its neighbours, then
    its label's label, until none changes: few rounds for any shape, each written out.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = checkpointed(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = checkpointed(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(label.withColumnsRenamed({"node": "y", "root": "r"}), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = label.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = checkpointed(step.join(up, "root").select("node", "old", F.least("root", "up").alias("root")))
        label = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return label


def one_of_each(docs: DataFrame, n: int = N, t: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept.

    A group is a connected component of pairs at a similarity of t at least; the row
    with the least doc_id stays (nulls last, then the least hash of the text; of rows
    with the same doc_id and text one).  Rows whose text is null, empty or has no words
    are in no group and all stay; very long texts are compared whole; an empty table
    gives an empty one; columns may have any names.
    """
    members, sets_ = _classed(_keyed(docs, text, doc_id), n, t, BROADCAST_KEYS)
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    placed = checkpointed(_with_sets(members.filter("sig is not null"), sets_).filter("n_links > 0").select("doc_id", "t", row.eqNullSafe(F.col("first")).alias("stays")))
    drop = checkpointed(placed.filter("not stays").select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t")).distinct())
    small = drop.count() <= DROP_ROWS
    here = lambda other, i, h: docs[doc_id].cast("bigint").eqNullSafe(other[i]) & (F.xxhash64(docs[text]) == other[h])
    left = docs.join(F.broadcast(drop) if small else drop, here(drop, "drop_id", "drop_t"), "left_anti")
    again = placed.filter("stays").groupBy(F.col("doc_id").alias("again_id"), F.col("t").alias("again_t")).agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    if again.isEmpty():
        return left
    here = lambda other, i, h: left[doc_id].cast("bigint").eqNullSafe(other[i]) & (F.xxhash64(left[text]) == other[h])
    repeated = left.join(again, here(again, "again_id", "again_t"), "left_semi").dropDuplicates([doc_id, text])
    return left.join(again, here(again, "again_id", "again_t"), "left_anti").unionByName(repeated)


def sql(n: int = N, t: float = THRESHOLD) -> str:
    """``near_duplicates`` in DuckDB SQL over ``documents`` with distinct doc_ids."""
    return f"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-/:-`{{-\\x7f\\x{{80}}-\\x{{a9}}\\x{{ab}}-\\x{{b4}}\\x{{b6}}-\\x{{b9}}\\x{{bb}}-\\x{{bf}}\\x{{2000}}-\\x{{207f}}\\x{{3000}}-\\x{{303f}}]+'), lambda x: x <> '') as ws from documents),
    g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {n} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i : i + {n - 1}], ' ')) end) as gram from w),
    k as (select doc_id, count(*) as size from g group by doc_id),
    o as (select x.doc_id as doc_a, y.doc_id as doc_b, count(*) as common from g x join g y on x.gram = y.gram and x.doc_id < y.doc_id group by all),
    p as materialized (select doc_a, doc_b from o join k a on a.doc_id = doc_a join k b on b.doc_id = doc_b where common >= {t} * (a.size + b.size - common) - 1e-9),
    e as materialized (select doc_a as x, doc_b as y from p union all select doc_b, doc_a from p),
    reach as (select doc_id as x, doc_id as y from documents union select reach.x, e.y from reach join e on reach.y = e.x)
    select doc_id, class_id, coalesce(n_links, 0) as n_links from (select x as doc_id, min(y) as class_id from reach group by x) left join (select x as doc_id, count(*) as n_links from e group by x) using (doc_id)"""
