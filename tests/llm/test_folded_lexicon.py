"""Stems and entries in scripts that fold to Latin letters, and labelled words that are disguised."""

from __future__ import annotations

import random

from lodestone.llm import toxicity


def test_entries_are_folded_like_texts():
    a = toxicity._automaton((("тварь", 1.5, False), ("ηλίθιος", 1.5, True), ("kalın", 1.0, True)), ("морская тварь",))
    assert toxicity.hits("ты тварь", a) == (1, 1.5)
    assert toxicity.hits("ένας ηλίθιος", a) == (1, 1.5)
    assert toxicity.hits("kalın ve kalin", a) == (2, 2.0)
    assert toxicity.hits("вот морская тварь", a) == (0, 0.0)


def _tables(spark, marked, letters):
    r = random.Random(5)
    word = lambda: "".join(r.choice(letters) for _ in range(6))
    vocabulary = [word() for _ in range(300)]
    rows = [(k, " ".join([*(r.choice(vocabulary) for _ in range(30)), *([marked] if k % 2 else [])])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")


def test_stems_learned_in_cyrillic_match(spark):
    docs, labels = _tables(spark, "мразота", "абвгдежзик")
    found = {r["doc_id"]: r["n_hits"] for r in toxicity.toxicity(docs, toxicity.trained_lexicon(docs, labels)).collect()}
    assert all((n > 0) == (k % 2 == 1) for k, n in found.items())


def test_disguised_labelled_words_are_learned_as_what_they_stand_for(spark):
    docs, labels = _tables(spark, "z0rkеn", "abcdefghik")  # a digit, and a Cyrillic letter
    lexicon = toxicity.trained_lexicon(docs, labels)
    automaton = toxicity._automaton(lexicon, toxicity.EXCEPTIONS)
    assert toxicity.hits("such a zorken", automaton)[0] == toxicity.hits("such a z0rkеn", automaton)[0] == 1
    assert toxicity.hits("in 2013 and 1984", automaton)[0] == 0
