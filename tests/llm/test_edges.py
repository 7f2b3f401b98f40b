"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontaminate, fingerprints, html_text, langid, line_dedup, ngram_join, pii, toxicity

CLASH = ("gone", "gone_id", "gone_t", "key", "row", "r", "k", "g", "sig", "size", "t", "h", "a", "b", "pos", "site", "tokens", "drop_id", "drop_t", "again_id", "again_t", "toxicity", "GONE_ID_")
PROSE = "the quick brown fox jumps over the lazy dog while nine clever otters watch from the river bank\n"
LONG = "".join(f"word{k} and more of it\n" for k in range(40_000))


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, PROSE, "en", "s1", 5), (1, PROSE, "en", "s1", 5), (2, PROSE, "en", "s2", 5), (3, None, "en", "s3", None), (None, PROSE, None, None, None), (4, "", "de", "s4", 0), (5, "   \n\n", None, "s5", 5), (6, LONG, "en", "s6", 5), (7, LONG, "en", "s6", 5), (8, "a", "en", "s1", 1), (9, "!?", "en", "s1", 2)]
    return _docs(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def bench_items(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "too short")], "item_id bigint, text string")


def test_pii(edge, empty):
    assert pii.find(edge).count() == 0 and pii.find(empty).count() == 0
    assert edge.select(pii.redacted(F.col("text")).alias("x")).filter("x is null").count() == 1


def test_toxicity(spark, edge, empty):
    rows = toxicity.toxicity(edge).collect()
    assert len(rows) == 11 and not any(r["is_toxic"] for r in rows)
    assert [r["n_words"] for r in rows if r["doc_id"] in (3, 4)] == [0, 0]
    assert toxicity.toxicity(empty).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.trained_lexicon(edge, labels) == toxicity.default_lexicon()
    assert toxicity.trained_lexicon(empty, labels.limit(0)) == toxicity.default_lexicon()


def test_langid(edge, empty):
    net = langid.train(langid.sample(edge))
    rows = langid.identify(edge, net).collect()
    assert len(rows) == 11 and all((r["language"] is None) == (r["n_windows"] == 0) for r in rows)
    assert langid.identify(empty, net).count() == 0
    assert langid.train(langid.sample(empty)) is None
    assert {r["language"] for r in langid.identify(edge, None).collect()} == {None}


def test_fingerprints(edge, empty):
    rows = fingerprints.fingerprints(edge).collect()
    assert len(rows) == 11 and all(r["n_anchors"] == len(r["positions"]) == len(r["hashes"]) for r in rows)
    assert all(r["n_anchors"] == 0 for r in rows if r["doc_id"] in (3, 4, 5, 8, 9))
    assert len({tuple(r["hashes"]) for r in rows if r["doc_id"] in (1, 2, None)}) == 1
    assert fingerprints.fingerprints(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", "x"), (None, 2, "assistant", None), (2, 1, "user", ""), (3, 1, "assistant", "y" * 100_000)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(1).alias("template"), F.lit(1).alias("start"), F.lit(1).alias("turns"))
    found = chat.spans(talks)
    assert found.count() == 5 * len(rows) and chat.spans(talks.limit(0)).count() == 0


def test_decontaminate(edge, empty, bench_items):
    found = decontaminate.contamination(edge, bench_items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in found) == sorted((d, i) for d in (0, 1, 1, 2) for i in (0, 1, 1))
    assert decontaminate.contamination(empty, bench_items).count() == 0
    assert decontaminate.contamination(edge, bench_items.limit(0)).count() == 0
    kept = decontaminate.clean_only(edge, bench_items)
    assert kept.columns == edge.columns and kept.count() == 7
    assert decontaminate.clean_only(edge, bench_items.limit(0)).count() == 11
    sliced = decontaminate.contamination(edge, bench_items, slice_chars=100).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, found))


def test_line_dedup(spark, edge, empty):
    stripped = {(r["doc_id"], r["n_removed"]) for r in line_dedup.strip_lines(edge).collect()}
    assert stripped == {(k, 0) for k in (1, 2, 3, None, 4, 5, 6, 7, 8, 9)}
    more = _docs(spark, [(k, PROSE + f"own {k}", "en", f"s{k}", 9) for k in (3, 1, 2)] + [(None, PROSE, "en", "s9", 9), (1, PROSE + "own 1", "en", "s1", 9)])
    for limit in (0, 100):
        rows = line_dedup.without_boilerplate(more, broadcast_bytes=limit)
        assert rows.columns == more.columns
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows.collect()) == [(1, PROSE + "own 1", 9), (1, PROSE + "own 1", 9), (2, "own 2", 5), (3, "own 3", 5)]
    assert line_dedup.strip_lines(empty).count() == 0 and line_dedup.without_boilerplate(empty).columns == edge.columns


def test_bpe(spark, edge, empty):
    rows = bpe.encode(edge, chunk=1000, overlap=64).collect()
    assert len(rows) == 11 and all(r["exact"] for r in rows)
    assert [r["tokens"] for r in rows if r["doc_id"] in (3, 4)] == [None, []]
    whole = {r["doc_id"]: r["tokens"] for r in bpe.encode(edge, chunk=10**7).collect()}
    assert all(whole[r["doc_id"]] == r["tokens"] for r in rows)
    assert bpe.encode(empty).count() == 0
    named = bpe.encode(edge, keep=("doc_id", "key", "row", "r"))
    assert named.columns == ["doc_id", "key", "row", "r", "n_tokens", "tokens", "exact"] and named.count() == 11


def test_ngram_join(edge, empty):
    classes = sorted(map(tuple, ngram_join.near_duplicates(edge).collect()), key=str)
    assert classes == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0), (None, 1, 3)]
    assert ngram_join.near_duplicates(empty).count() == 0
    assert sorted(map(tuple, ngram_join.near_duplicates(edge, broadcast_keys=0).collect()), key=str) == classes
    named, pairs = ngram_join.pairs(edge)
    assert named.count() == 11 and named.filter("set is null").count() == 4 and pairs.count() == 0
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert ngram_join.one_of_each(empty).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50_000), (4, "u", "<script>never closed " * 10), (4, "u", "<a <b <c \"' <")], "page_id bigint, url string, html string")
    rows = html_text.extract(pages.select("*", F.lit(1).alias("title"), F.lit(1).alias("text"))).collect()
    assert len(rows) == 5
    got = {(r["page_id"], r["text"] if r["text"] is None else len(r["text"])) for r in rows}
    assert {(1, None), (2, 0), (None, 249_999)} <= got
    assert html_text.extract(pages.limit(0)).count() == 0
