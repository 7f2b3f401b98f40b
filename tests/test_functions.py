from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import example, given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import codec, lexer
from lodestone.functions import text as ft
from lodestone.operators import definitions

GOLDEN = {0: [0], 1: [1], 12: [12], 127: [127], 128: [129, 0], 12345: [224, 57], 12345678: [133, 241, 194, 78]}


@pytest.mark.parametrize("x", GOLDEN)
def test_golden_numbers(x):
    assert list(codec.encode_number(x)) == GOLDEN[x]
    assert list(codec.numbers(bytes(GOLDEN[x]))) == [x]


def test_golden_postings():
    data = codec.encode_postings([(1, [10, 20]), (2, [3, 5, 8])])
    assert list(data) == [2, 2, 3, 3, 5, 8, 1, 2, 10, 20]
    assert codec.decode_postings(data) == [(1, [10, 20]), (2, [3, 5, 8])]


@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.lists(st.integers(0, 1 << 31), max_size=5)), max_size=6))
def test_postings_come_back(postings):
    assert codec.decode_postings(codec.encode_postings(postings)) == postings


POSTINGS = pa.list_(pa.struct([("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))]))


@given(st.lists(st.none() | st.lists(st.tuples(st.integers(0, 1 << 62), st.lists(st.integers(0, (1 << 31) - 1), max_size=5)), max_size=4), max_size=6), st.integers(0, 2))
def test_columns_are_encoded_as_single_lists_are(rows, skip):
    column = pa.array([None if r is None else [{"doc_id": d, "positions": at} for d, at in r] for r in rows], POSTINGS).slice(skip)
    data = codec._encoded(column)
    assert data.to_pylist() == [None if r is None else codec.encode_postings(r) for r in rows[skip:]]
    assert codec._decoded(data).to_pylist() == column.to_pylist()


def test_negative_numbers_in_columns_have_no_encoding():
    with pytest.raises(ValueError):
        codec._encoded(pa.array([[{"doc_id": -1, "positions": []}]], POSTINGS))


def test_json_objects_and_ancestors(spark):
    df = spark.createDataFrame([(("A-b", [(1, None)]), "/x/tests/y.lisp"), (None, "/tests")], "s struct<`System-NAME`: string, parts: array<struct<`No`: int, Q: double>>>, f string")
    rows = df.select(ft.json_encoded(F.col("s"), df.schema["s"].dataType).alias("j"), ft.below(F.col("f"), "tests").alias("b")).collect()
    assert rows[0]["j"] == '{"system_name":"A-b","parts":[{"no":1,"q":null}]}' and rows[1]["j"] is None
    assert [r["b"] for r in rows] == [True, False]


def test_symbols_at_home(spark):
    df = spark.createDataFrame([("a", "P", "P"), ("b", "P", "CL"), ("c", "P", None)], "name string, package_name string, home_package string")
    assert [r["name"] for r in definitions.at_home(df).collect()] == ["a"]


@given(st.lists(st.integers(0, 1 << 62), max_size=20))
def test_lists_come_back(xs):
    assert codec.decode_list(codec.encode_list(xs)) == xs


def test_negative_numbers_have_no_encoding():
    with pytest.raises(ValueError):
        codec.encode_number(-1)


def test_encoding_and_its_length_as_columns(spark):
    df = spark.createDataFrame([([(1, [10, 200])],), ([],), (None,)], f"p {codec.POSTINGS}")
    rows = df.select("p", codec.encoded("p").alias("e"), codec.decoded(codec.encoded("p")).alias("d")).collect()
    assert [r["e"] and bytes(r["e"]) for r in rows] == [bytes([1, 1, 2, 10, 129, 72]), bytes([0]), None]
    assert [r["d"] for r in rows] == [r["p"] for r in rows]
    n = spark.createDataFrame([(x,) for x in GOLDEN], "x bigint").select("x", codec.number_bytes(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in n} == {x: len(b) for x, b in GOLDEN.items()}


@pytest.mark.parametrize("text, terms", [("abcdefg", ["abc", "bcd", "cde", "def", "efg"]), ("あいうえお", ["あいう", "いうえ", "うえお"]), ("", []), ("ab", []), ("abc", ["abc"]), ("aé😀b", ["aé😀", "é😀b"]), (None, [])])
def test_trigrams(spark, text, terms):
    assert spark.createDataFrame([(text,)], "x string").select(ft.trigrams(F.col("x"))).first()[0] == terms


def test_trigrams_take_linear_time(spark):
    assert spark.range(1).select(F.size(ft.trigrams(F.repeat(F.lit("abcde"), 40_000)))).first()[0] == 199_998


@pytest.mark.parametrize("query, name, package", [("cl:car", "CAR", "CL"), ("a:b:c", "C", "A:B"), ("a:::b", "B", "A:"), ("::k", "K", None), (":k", "K", None), ("foo", "FOO", None)])
def test_symbol_queries(spark, query, name, package):
    row = spark.range(1).select(ft.symbol_name(F.lit(query)), ft.symbol_package(F.lit(query))).first()
    assert tuple(row) == (name, package)


@pytest.mark.parametrize("file, root, to", [("/r/p/src/x", "/r/p", "src/x"), ("/a/b", "", "a/b"), ("/other/file", "/r/p", "/other/file"), ("/r", "/r/p", "/r"), ("/a/b", None, "a/b")])
def test_relative_paths(spark, file, root, to):
    df = spark.createDataFrame([(file, root)], "f string, r string")
    assert df.select(ft.relative_path(F.col("f"), F.col("r"))).first()[0] == to


@pytest.mark.parametrize("body, at, line", [("ab\ncd", 1, "ab"), ("ab\ncd", 2, "ab"), ("ab\ncd", 3, "cd"), ("one", 0, "one"), ("é😀\nx", 3, "x")])
def test_line_around_a_place(spark, body, at, line):
    df = spark.createDataFrame([(body, at)], "b string, s int")
    assert df.select(ft.line_at(F.col("b"), F.col("s"))).first()[0] == line


@pytest.mark.parametrize("text", ['a"b\\c\n\t\r\b\f', "\x01\x1f", "é", "😀 𝄞", "", "plain"])
def test_json_escapes(spark, text):
    out = spark.createDataFrame([(text,)], "x string").select(ft.json_escaped(F.col("x"))).first()[0]
    assert json.loads(f'"{out}"') == text
    assert all(0x20 <= ord(c) < 0x10000 for c in out)


def test_project_root(spark):
    df = spark.createDataFrame([("/d/p/src/x.lisp", "/d"), ("/d/x", "/d"), ("/e/p/x", "/d")], "f string, r string")
    assert [r[0] for r in df.select(ft.project_root(F.col("f"), F.col("r"))).collect()] == ["/d/p", None, None]


LEXED = {
    "foo": [("foo", 0)], "   foo": [("foo", 3)], "'foo": [("'", 0), ("foo", 1)], "(cons car cdr)": [("(", 0), ("cons", 1), ("car", 6), ("cdr", 10), (")", 13)], "|f  \\|oo| xxx": [("|f  \\|oo|", 0), ("xxx", 10)],
    '"foo\\"xbar"': [('"foo\\"xbar"', 0)], "#:\\|": [("\\|", 0)], "foo;\n": [("foo", 0), ("", 3)], "foo;comment\nbar": [("foo", 0), ("comment", 3), ("bar", 12)], "#\\space": [("space", 0)], "#\\'": [("'", 0)], "#'car": [("car", 0)],
    "#'(lambda ())": [("#'", 0), ("(", 2), ("lambda", 3), ("(", 10), (")", 11), (")", 12)], "#(abc)": [("#(", 0), ("abc", 2), (")", 5)], "#1=(x)": [("#1=", 0), ("(", 3), ("x", 4), (")", 5)], "#|#|foo|#|#": [("#|foo|#", 0)],
    "abc あいうえお xyz": [("abc", 0), ("あいうえお", 4), ("xyz", 10)], "": [], "#| open": [(" open", 0)], '"open': [('"open', 0)],
}


@pytest.mark.parametrize("text", LEXED)
def test_lexer(text):
    assert [t[:2] for t in lexer.tokens(text)] == LEXED[text]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("foo; x\n", "SYMBOL LINE-COMMENT"), ("foo;\nbar", "SYMBOL LINE-COMMENT SYMBOL"), ("#\\space", "CHARACTER"), ("#\\'", "CHARACTER"), ("#'car", "FUNCTION-OBJECT"), ("#'(f ())", "T T SYMBOL T T T"), ("#(abc)", "T SYMBOL T"), ("#:foo", "UNINTERN-SYMBOL"),
        ("#| a #||# |#", "BLOCK-COMMENT"), ("#1=(x)", "T T SYMBOL T"), ("abc あい", "SYMBOL SYMBOL"), ('"s" \'q', "STRING T SYMBOL"), ("#:\\|", "UNINTERN-SYMBOL"), ("|a b| c", "SYMBOL SYMBOL"),
    ],
)
def test_kinds_of_tokens(text, kinds):
    assert [k for _, _, k in lexer.tokens(text)] == kinds.split()


@example('"\\')
@example('a"b\\"\\')
@given(st.text("ab#'\\|\"; \n():1=", max_size=40))
def test_lexer_ends_and_moves_on(text):
    at = [p for _, p, _ in lexer.tokens(text)]
    assert at == sorted(set(at))


def test_lexed_table(spark):
    docs = spark.createDataFrame([(1, "(a)"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in lexer.lex(docs).orderBy("position").collect()] == [(1, "(", 0, "T"), (1, "a", 1, "SYMBOL"), (1, ")", 2, "T")]
