"""Disguised insults are found, and texts about animals, waste and machines stay."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import toxicity

AUTOMATON = toxicity._automaton(toxicity.default_lexicon(), toxicity.EXCEPTIONS)
FILLER = "we walked along the lake and talked about the summer until the rain came"


@pytest.mark.parametrize(
    "word",
    ["idiot", "id\u200biot", "id\u00adiot", "\u00eddiot", "i\u0301diot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\U0001d408\U0001d41d\U0001d422\U0001d428\U0001d42d", "!diot", "1d10t", "\uff49\uff44\uff49\uff4f\uff54", "\u0456di\u043et", "i\u2060d\ufeffiot", "IDIOT", "id\u0131ot", "ID\u0130OT"],
)
def test_disguises(word):
    for text in (word, f"you {word}!", f"{FILLER}. {word}, {FILLER}"):
        assert toxicity.hits(text.lower(), AUTOMATON)[0] == 1, text
    assert toxicity.score_text(f"you {word} {FILLER}".lower(), AUTOMATON)[4]


@pytest.mark.parametrize(
    "text",
    [
        "the pig farm by the lake", "a rat ran over the farm", "ugly", "garbage is collected on monday", "trash", "the zoo has a snake, a pig, a rat, a dog and a donkey", "a hag stone", "the parasite lives in its host", "dumb", "filthy water", "vermin",
        "stupid me", "worthless paper", "a pathetic score", "the clown", "wow! great! what a day!", "", "!!!", "\u200b\u00ad", "idiotproof", "1 0 1 5 !",
    ],
)
def test_one_weak_word_makes_no_text_toxic(text):
    assert not toxicity.score_text(text, AUTOMATON)[4]


def test_length_counts():
    assert toxicity.score_text("moron " + FILLER, AUTOMATON)[4]
    assert not toxicity.score_text("moron " + f"{FILLER} " * 60, AUTOMATON)[4]
    assert toxicity.score_text("moron idiot scum loser " * 10 + f"{FILLER} " * 60, AUTOMATON)[4]


def test_labelled_rows_weigh_curated_words_anew():
    r = random.Random(4)
    rows = []
    for k in range(600):
        ws = {f"w{r.randint(0, 500)}x" for _ in range(20)}
        rows.append((k % 2, k, sorted(ws | ({"trash"} if k % 4 == 1 else set()) | ({"moron"} if r.random() < 0.1 else set()))))
    rows.sort()
    weights = {w: x for w, x, _ in toxicity.learn(lambda: iter(rows))}
    assert weights["trash"] > 1 and "moron" not in weights and weights["clown"] == 0.5
