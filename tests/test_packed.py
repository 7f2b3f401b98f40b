"""Packed postings: the same as a row for each, in few bytes, whatever is done with them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lodestone.functions import codec, packed
from lodestone.operators import definitions, index, merge, search, store
from lodestone.plans import corpus


def _docs(spark, seed=3, many=60, step=1):
    r = random.Random(seed)
    rows = [(k * step, "".join(r.choice("abé😀\n") for _ in range(r.choice((0, 2, 3, 40, 400))))) for k in range(many)] + [(many * step, None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, body string").repartition(3)


def _all(df):
    return sorted((r["term"], r["doc_id"], tuple(r["positions"])) for r in df.collect())


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_blocks_of_texts(most):
    texts = pa.array(["zz", "abc", None, "", "é😀é😀é", "ababab"]).slice(1)
    found = {}
    for lo, _, code, size in packed.blocks(texts, most):
        block = packed.Block(code, size)
        row, key, postings = block.by_text()
        for t, d, a, b in zip(block.terms(key).to_pylist(), lo + row, postings.at, postings.at[1:]):
            found[t, int(d)] = postings.positions[a:b].tolist()
    assert found == {("abc", 0): [0], ("é😀é", 3): [0, 2], ("😀é😀", 3): [1], ("aba", 4): [0, 2], ("bab", 4): [1, 3]}


def test_many_letters_are_sorted_too():
    text = "".join(map(chr, range(0x4E00, 0x9E00))) * 2
    ((_, _, code, size),) = packed.blocks(pa.array([text] * 70), 1 << 30)
    block = packed.Block(code, size)
    assert (block.base**3 * block.rows) << 22 > 1 << 64  # more than one number holds
    _, key, postings = block.by_term()
    terms = block.terms(key).to_pylist()
    assert len(terms) == 70 * 20_480 and list(postings.doc[:70]) == list(range(70))
    for k in range(0, len(terms), 50_021):
        at = postings.positions[postings.at[k] : postings.at[k + 1]].tolist()
        assert at == [p for p in (text.find(terms[k]), text.rfind(terms[k]) if text.count(terms[k]) > 1 else None) if p is not None]


def test_packed_rows_come_back(spark):
    docs = _docs(spark)
    want = _all(index.postings(docs))
    assert len(want) > 1000
    for rows in (index.packed(docs, documents=7), index.packing(index.postings(docs), documents=7)):
        assert _all(index.unpacked(rows)) == want
        assert all(r["segment"] == r["doc_id"] // 7 for r in rows.collect())


def test_lists_are_whole_and_in_order(spark):
    docs = _docs(spark)
    lists = index.posting_segments(index.packed(docs, documents=16)).collect()
    assert len({(r["term"], r["segment"]) for r in lists}) == len(lists)
    assert all([p["doc_id"] for p in r["postings"]] == sorted(p["doc_id"] for p in r["postings"]) for r in lists)
    assert sorted((r["term"], p["doc_id"], tuple(p["positions"])) for r in lists for p in r["postings"]) == _all(index.postings(docs))


def test_only_wanted_terms(spark):
    docs = _docs(spark)
    assert _all(index.postings(docs, terms=["aba", "é😀b", "xyz"])) == [x for x in _all(index.postings(docs)) if x[0] in ("aba", "é😀b")]


def test_encodings_of_segments(spark):
    docs = _docs(spark, step=1000)
    lists = {(r["term"], r["segment"]): [(p["doc_id"], p["positions"]) for p in r["postings"]] for r in index.posting_segments(index.packed(docs)).collect()}
    rows = index.encoded_segments(index.packed(docs)).collect()
    assert len(rows) == len(lists)
    for r in rows:
        one = lists[r["term"], r["segment"]]
        assert r["n_bytes"] == len(codec.encode_postings(one)) and r["same"]
        assert (r["n_docs"], r["back_docs"], r["back_positions"]) == (len(one), len(one), sum(len(p) for _, p in one))


def _plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["codec_roundtrip", "posting_encoded_bytes", "posting_lists", "posting_order_check", "insert_if_absent"])
def test_postings_travel_packed(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "Repartition" in plan and "data#" in plan and not {x for x in ("collect_list", "Window", "Join") if x in plan}


def test_postings_are_inserted_once(spark):
    kept = spark.createDataFrame([(1, "abcd"), (3, "xyz")], "doc_id bigint, body string")
    new = spark.createDataFrame([(1, "abcabc"), (2, "abc"), (5, "zzabc"), (5, "zabc")], "doc_id bigint, body string")
    want = {("abc", 1): (0,), ("bcd", 1): (1,), ("xyz", 3): (0,), ("bca", 1): (1,), ("cab", 1): (2,), ("abc", 2): (0,), ("abc", 5): (1,), ("zab", 5): (0,), ("zza", 5): (0,)}
    got = _all(index.insert_postings(kept, new))
    assert {(t, d): p for t, d, p in got} == want and len(got) == len(want)
    generic = index.insert_if_absent(index.postings(kept), index.postings(new), "term", "doc_id")
    assert _all(generic) == got


@pytest.mark.parametrize("name", ["describe_index", "token_by_id", "document_frequency", "index_size"])
def test_terms_are_made_in_the_scan(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan


def test_merged_postings_take_names_along(spark, sf_dir):
    one = merge.merged(corpus.by_language(corpus.document(spark, sf_dir).filter("doc_id < 20"), also=["filename"]))
    assert set(one["inverted_index"].columns) == {"term", "doc_id", "positions", "filename"}
    names = {r["doc_id"]: r["filename"] for r in one["document"].collect()}
    assert all(names[r["doc_id"]] == r["filename"] for r in one["inverted_index"].select("doc_id", "filename").distinct().collect())


def test_postings_are_stored_packed_and_counted(spark, tmp_path):
    docs = _docs(spark).selectExpr("doc_id", "'f' || doc_id as filename", "body")
    postings = index.postings(docs)
    for k, rows in enumerate((postings, index.packed(docs))):
        out = str(tmp_path / f"{k}.index")
        store.create(spark, out)
        store.write(out, {"inverted_index": rows, "document": docs}, tasks=9)
        assert {"data", "n_docs"} <= set(spark.read.parquet(f"{out}/inverted_index").columns)
        r = store.read(spark, out)
        assert _all(r["inverted_index"]) == _all(postings)
        assert {x["relation"]: x["n"] for x in store.sizes(spark, out).collect()} == {n: x.count() for n, x in r.items()}
        # only the phrase's terms are read, and no position is a row of a shuffle
        found = search.index_phrase(r["inverted_index"], r["document"], "abab")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan
        assert "term" in found._jdf.queryExecution().executedPlan().toString().split("DataFilters: [", 1)[1].split("]")[0]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.scan_phrase(docs.filter("body is not null"), "abab").collect()))


def test_line_heads_are_found_text_by_text():
    # not a column that could be fetched as a whole
    found = definitions._line_heads([pa.scalar("ab c\nDe\n\n1x"), pa.scalar(None, pa.string()), pa.scalar("")])
    assert found.to_pylist() == [[{"name": "AB", "position": 0}, {"name": "DE", "position": 5}], [], []]
