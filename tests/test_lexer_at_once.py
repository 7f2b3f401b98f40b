from __future__ import annotations

import random

from lodestone.functions import lexer


def test_tokens_at_once_are_those_of_the_lexer():
    r = random.Random(8)
    parts = ["a", "b1", "é", "(", ")", "'", "`", ",", ";", '"', "\\", "|", "#", "#|", "|#", "#'", "#:", "#\\", "#1=", "\n", " ", "　", "="]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [(t, p, lexer._KINDS[k]) for t, p, k in lexer.tokens_at_once(text)] == list(lexer.tokens(text))


def test_tokens_of_several_texts_come_together(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "#|x|# c")], "doc_id bigint, text string").coalesce(1)
    assert [tuple(r) for r in lexer.lex(docs).collect()] == [(1, "a", 0, "SYMBOL"), (1, "b", 2, "SYMBOL"), (4, "x", 0, "BLOCK-COMMENT"), (4, "c", 6, "SYMBOL")]
