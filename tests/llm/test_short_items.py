"""Decontamination by items of every length, against verification on all diagonals."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
import pytest

from lodestone.llm import decontaminate


def _segment(same):
    """Matches of the first range with the largest sum of +1 and -2, by trying all."""
    best, n = 0, 0
    for b in range(1, len(same) + 1):
        for a in range(b):
            s = sum(1 if x else -2 for x in same[a:b])
            if s > best:
                best, n = s, sum(same[a:b])
    return n


@pytest.mark.parametrize("n", range(1, 21))
def test_recall_by_length(n):
    item = [f"word{k}" for k in range(n)]
    texts, want = [], []
    for many in range(3):
        for at in itertools.combinations(range(n), many):
            same = [k not in at for k in range(n)]
            texts.append(" ".join(["before", "it", *(w if x else f"other{k}" for k, (w, x) in enumerate(zip(item, same))), "after"]))
            found = _segment(same)
            want.append(found >= min(decontaminate.LEAST_SEGMENT, n) and found >= min(decontaminate.LEAST_WORDS, math.ceil(decontaminate.LEAST_SHARE * n)))
    got = {r for r, *_ in decontaminate.overlaps(pa.array(texts), decontaminate.Index([1], [" ".join(item)]))}
    right = {k for k, x in enumerate(want) if x}
    assert 0 in got and got <= right and len(got) >= 0.9 * len(right)


def test_short_items_of_many_lengths_at_once():
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in range(1, 20)]
    texts = ["", *(f"x {t} y {t} z" for t in items), "i3w0 i3w1 x i3w2 i2w1 i2w0", "i4w0 i4w1"]
    found = list(decontaminate.overlaps(pa.array(texts), decontaminate.Index(list(range(len(items))), items)))
    assert [(r, i) for r, i, *_ in found] == [(k + 1, k) for k in range(19)]
    assert all(n == size and at == 1 for _, _, n, size, at in found)
