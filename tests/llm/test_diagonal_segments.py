"""Runs of matches on one diagonal that are parted by other words add up."""

from __future__ import annotations

import math
import random

import pyarrow as pa

from lodestone.llm import decontaminate


def _found(text, item):
    return [tuple(map(int, x[2:])) for x in decontaminate.overlaps(pa.array([" ".join(text)]), decontaminate.Index([1], [" ".join(item)]))]


def test_three_runs_of_ten_on_one_diagonal():
    item = [f"w{k}" for k in range(40)]
    text = [w if k % 15 < 10 else f"other{k}" for k, w in enumerate(item)]
    assert _found(["before", *text], item) == [(30, 40, 1)]


def _brute(same, least):
    """Matched words of all ranges, the first shortest one with the largest sum and then on both sides."""
    best = (0, 0, 0)
    for b in range(1, len(same) + 1):
        for a in range(b):
            s = sum(1 if x else -2 for x in same[a:b])
            if s > best[0]:
                best = (s, a, b)
    s, a, b = best
    if not s:
        return 0
    n = sum(same[a:b])
    return (n if n >= least else 0) + _brute(same[:a], least) + _brute(same[b:], least)


def test_random_substitutions_agree_with_all_ranges():
    r = random.Random(6)
    item, right, found = [f"w{k}" for k in range(40)], 0, 0
    for _ in range(150):
        same = [x for _ in range(10) for x in [r.random() < 0.6] * r.choice([2, 4, 6])][:40]
        same += [False] * (40 - len(same))
        want = _brute(same, decontaminate.LEAST_SEGMENT)
        got = _found([w if x else f"other{k}" for k, (w, x) in enumerate(zip(item, same))], item)
        if want >= min(decontaminate.LEAST_WORDS, math.ceil(decontaminate.LEAST_SHARE * 40)):
            right += 1
            found += bool(got)
        else:
            assert not got
        assert all(n == want for n, _, _ in got)
    assert right > 20 and found >= 0.9 * right
