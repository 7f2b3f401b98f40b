"""Whole operators against brute force that shares no code with them."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import durable, fingerprints, langid
from lodestone.llm import textcore as tc


def _forward(net, window):
    """The network on one window, layer by layer, without tables."""
    e = net.p["e"][np.frombuffer(window.ljust(langid.WINDOW, b"\0"), np.uint8)].astype(float)
    pooled = []
    for w in langid.WIDTHS:
        filters = net.p[f"f{w}"].astype(float)
        answers = [np.einsum("ke,kef->f", e[i : i + w], filters) for i in range(len(e) - w + 1)]
        pooled.append(np.maximum(0, np.max(answers, 0) + net.p[f"b{w}"]))
    z = np.concatenate(pooled) @ net.p["o"] + net.p["c"]
    return z - z.max() - math.log(np.exp(z - z.max()).sum())


def test_identify_agrees_with_window_by_window(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.train(langid.sample(docs, rows_each=40), epochs=2)
    some = [r for r in docs.orderBy("doc_id").limit(12).collect()]
    extra = [(9001, None), (9002, ""), (9003, "x"), (None, "é" * 200), (9004, "ab " * 171), (9004, "ab " * 171)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in some] + extra, "doc_id bigint, text string")
    got = sorted(map(tuple, langid.identify(df, net).collect()), key=str)
    want = []
    for i, text in [(r["doc_id"], r["text"]) for r in some] + extra:
        raw = (text or "").lower().encode()
        pieces = [raw[k : k + langid.WINDOW] for k in range(0, len(raw), langid.WINDOW)]
        if not pieces:
            want.append((i, None, None, 0))
            continue
        z = sum(_forward(net, x) * len(x) for x in pieces) / len(raw)
        p = np.exp(z - z.max())
        p /= p.sum()
        want.append((i, net.languages[int(p.argmax())], float(p.max()), len(pieces)))
    want.sort(key=str)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), str(r[3]))), sorted(want, key=lambda r: (str(r[0]), str(r[3])))):
        assert a[0] == b[0] and a[1] == b[1] and a[3] == b[3]
        assert (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-3)


def test_syncmers_at_their_real_size():
    """Selected k-mers by definition, with the operator's hash of an s-mer, over equal, low and random texts."""
    r = random.Random(8)
    k, s = fingerprints.K, fingerprints.S
    for text in ("".join(r.choice("abcdefgh \u00e9") for _ in range(900)), "a" * 300, "ab" * 200, "".join(r.choice("ab") for _ in range(500)), "x" * (k - 1), "x" * k, ""):
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hash_of = {}
        for i in range(len(text) - s + 1):
            hash_of.setdefault(text[i : i + s], int(fingerprints._smers(code[i : i + s], s)[0]))
        want = []
        for i in range(len(text) - k + 1):
            inner = [hash_of[text[j : j + s]] for j in range(i, i + k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append(i)
        at, g = fingerprints.syncmers(code)
        assert at.tolist() == want
        by_text = {}
        for p, x in zip(at.tolist(), g.tolist()):
            assert by_text.setdefault(text[p : p + k], x) == x
        assert len(set(by_text.values())) == len(by_text)


def test_matches_with_first_places(spark):
    r = random.Random(2)
    prose = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared, other = prose(400), prose(300)
    rows = [(k, prose(50 + k) + shared + prose(30)) for k in range(30)] + [(100, other), (101, prose(90) + other), (101, prose(90) + other), (102, None), (103, ""), (None, shared), (104, prose(500))]
    f = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("hash", F.lit(1)))
    found = {(x["doc_a"], x["doc_b"]): x["shift"] for x in fingerprints.matches(f, f).collect()}
    assert found == {(k, 0): -k for k in range(1, 30)} | {(101, 100): -90}
    assert fingerprints.matches(f, f.limit(0)).count() == fingerprints.matches(f.limit(0), f).count() == 0


def test_words_in_pieces_hash_the_same(monkeypatch):
    r = random.Random(6)
    text = " ".join("".join(r.choice("abc\u00e9\u4e2d") for _ in range(r.choice([1, 3, 9, 400]))) for _ in range(500)).encode()
    b, off = np.frombuffer(text, np.uint8), np.array([0, 100, len(text)])
    whole = tc.words(b, off)
    monkeypatch.setattr(tc, "PIECE_BYTES", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, tc.words(b, off)))


def test_written_tables_can_be_discarded(spark):
    table = durable.written(spark.range(10))
    assert table.count() == 10
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    import os

    assert os.path.isdir(folder)
    durable.discard(table)
    assert not os.path.exists(folder)
