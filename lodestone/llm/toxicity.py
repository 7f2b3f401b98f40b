"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

A text is lower-cased and folded (compatibility forms and accents undone, what has no
width taken out, homoglyphs of Latin letters, digits and signs that stand for letters,
punctuation to blanks), all lexicon entries are found in one pass, hits inside
exception phrases are taken back, and the summed weight is divided by the length in
words.

The lexicon is a curated list of English insults plus stems that ``learn`` finds
in a bounded sample of labelled rows, so other languages need no list of their own;
the sample also weighs the curated ones anew.  Entries and labelled words are folded
like the texts, whatever their script.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Insults with weights; they count as whole words, with the endings of _FORMS.  Those of 0.5
#: are used of things too: one of them makes no text toxic unless labelled rows raise its weight.
#: Names of animals that are insults at times aren't here at all.
WORDS = {
    "idiot": 1.5, "idiotic": 1.4, "moron": 1.5, "moronic": 1.4, "imbecile": 1.5, "scum": 1.8, "loser": 1.2, "worthless": 0.5, "pathetic": 0.5, "stupid": 0.5, "stupidity": 0.5,
    "disgusting": 0.5, "trash": 0.5, "trashy": 0.5, "clown": 0.5, "retard": 2.0, "retarded": 1.6, "bastard": 1.5, "asshole": 2.0, "bitch": 2.0, "fuck": 2.0, "fucker": 2.0, "fucking": 1.6,
    "motherfucker": 2.0, "dumbass": 2.0, "jackass": 1.5, "scumbag": 1.8, "vermin": 0.5, "subhuman": 2.0, "dipshit": 2.0, "bullshit": 1.2, "shithead": 2.0, "degenerate": 0.5, "halfwit": 1.3,
    "nitwit": 1.2, "dimwit": 1.2, "douchebag": 1.8, "wanker": 1.6, "slut": 2.0, "whore": 2.0, "pervert": 1.4, "parasite": 0.5, "shit": 1.4, "crap": 0.5, "cunt": 2.0, "dumb": 0.5,
    "filth": 0.5, "filthy": 0.5, "kys": 2.0,
}
_FORMS = ("", "s", "es")
#: Phrases in which a hit doesn't count.
EXCEPTIONS = (
    "clown fish", "clownfish", "clown car", "class clown", "circus clown", "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash",
    "idiot proof", "idiotproof", "pathetic fallacy", "pond scum", "soap scum", "garbage collection", "garbage collector", "guinea pig", "guinea pigs", "pig iron",
    "lab rat", "rat race", "dumb bell", "dumbbell", "dumb terminal", "retardant", "flame retardant", "fire retardant", "degenerate case", "degenerate matter", "host parasite", "scumble",
)
#: A text is toxic from this score on.
THRESHOLD = 0.003
#: Words added to each text's length, so that one hit in a very short text isn't all: of a
#: weight of 0.6 a text needs more than one hit, however short it is.
SMOOTH_WORDS = 200
#: Bounds of the sample of labelled rows that ``learn`` takes.
MOST_TOXIC, MOST_CLEAN = 1500, 6000

_LOOKALIKE = {
    "аα": "a", "вβ": "b", "сϲ": "c", "ԁ": "d", "еεё": "e", "ғ": "f", "ɡ": "g", "нһ": "h", "іιїı": "i", "јϳ": "j", "кκ": "k", "ӏ": "l", "м": "m", "ոη": "n",
    "оοσө": "o", "рρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "тτ": "t", "υս": "u", "ѵν": "v", "ԝω": "w", "хχ": "x", "уγ": "y", "ᴢ": "z",
}
_DIGIT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


def _table() -> dict[int, str]:
    t = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()}
    t |= {c: " " for c in (*range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3004)) if c not in (0xAA, 0xB5, 0xBA)}
    t |= {ord(c): to for many, to in _LOOKALIKE.items() for c in many}
    t |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: _DIGIT.get(str(k), str(k)) for k in range(10)}
    return t | {ord(c): to for c, to in _DIGIT.items()}


_FOLD = _table()


#: Combining marks of Latin, Greek and Cyrillic letters, and signs without width.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e01ef]+")
_BANG = re.compile(r"(?<![^\W_])!(?=[^\W\d_])")


def plain(text: str) -> str:
    """``text`` in lower case without compatibility forms, accents and signs without width."""
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


def _folded(text: str) -> str:
    """A plain text with look-alikes as Latin letters and punctuation as blanks; one character for each."""
    return (_BANG.sub("i", text) if "!" in text else text).translate(_FOLD)


def fold(text: str) -> str:
    """``text``, lower-cased already, as it is matched."""
    return _folded(plain(text))


def default_lexicon() -> tuple[tuple[str, float, bool], ...]:
    """(entry, weight, whole word) of the curated list."""
    return tuple((w + e, x, True) for w, x in WORDS.items() for e in _FORMS)


@lru_cache(maxsize=8)
def _automaton(lexicon: tuple[tuple[str, float, bool], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    a, found = ahocorasick.Automaton(), {}
    for w, x, whole in lexicon:
        w = fold(w)  # as the texts are
        if w not in found or found[w][0] < x:
            found[w] = (x, whole)
    for w in exceptions:
        found[fold(w)] = (0.0, True)
    for w, (x, whole) in found.items():
        a.add_word(" " + w, (len(w), x, whole))
    if found:
        a.make_automaton()
    return a


def hits(text: str, automaton: ahocorasick.Automaton) -> tuple[int, float]:
    """(hits, summed weight) in a lower-cased text.  Each word counts once, with the
    heaviest of its entries; a match of digits and signs alone isn't a word."""
    if not text or not len(automaton):
        return 0, 0.0
    by_start: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    text = plain(text)
    folded = " " + _folded(text)
    for end, (n, x, whole) in automaton.iter(folded):
        if whole and end < len(text) and text[end].isalpha():
            continue
        start = end - n  # in text, as folded has a blank more
        if not x:
            safe.append((start, end))
        elif any(c.isalpha() for c in text[start:end]):
            by_start[start] = max(x, by_start.get(start, 0.0))
    if safe:
        by_start = {s: x for s, x in by_start.items() if not any(a <= s < b for a, b in safe)}
    return len(by_start), sum(by_start.values())


SCORE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hits", T.LongType()),
    T.StructField("hit_weight", T.DoubleType()),
    T.StructField("toxicity", T.DoubleType()),
    T.StructField("is_toxic", T.BooleanType()),
])


def score_text(text: str | None, automaton: ahocorasick.Automaton, threshold: float = THRESHOLD) -> tuple[int, int, float, float, bool]:
    """A row of SCORE for a lower-cased text; null and empty texts score 0."""
    n, x = hits(text or "", automaton)
    length = len((text or "").split())
    score = round(x / (length + SMOOTH_WORDS), 6)
    return length, n, round(x, 4), score, score >= threshold


def _scorer(lexicon, threshold, exceptions=EXCEPTIONS):
    @F.arrow_udf(SCORE)
    def score(texts: pa.Array) -> pa.Array:
        a = _automaton(lexicon, exceptions)
        rows = [score_text(x.as_py(), a, threshold) for x in texts]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], SCORE.names)

    return score


def toxic(text: Column, lexicon=None, threshold: float = THRESHOLD) -> Column:
    """The struct SCORE of a text column."""
    return _scorer(tuple(lexicon or default_lexicon()), threshold)(F.lower(text))


def toxicity(docs: DataFrame, lexicon=None, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hits, hit_weight, toxicity, is_toxic of every row.

    A null or empty text has no words, scores 0 and isn't toxic; a null doc_id
    passes through; repeated rows each give a row; an empty table gives an empty
    one.  Other columns, whatever their names, are neither read nor returned.
    Very long texts are scored whole.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), toxic(F.col(text), lexicon, threshold).alias("r"))
    return out.select("doc_id", "r.*")


# ---- learning stems from labelled rows ---------------------------------------------------------

#: Letters, what fold() takes out, and the digits and signs that it makes letters of.
_SIGNS = r"([\p{L}\p{M}\p{Cf}" + "".join(chr(c) for c, to in _FOLD.items() if to.isalpha() and not chr(c).isalpha()) + "]+)"
#: Of a labelled row: whether it is toxic, its group (near copies share their least word hash) and its different words.
Labelled = tuple[int, int, list[str]]


def labelled_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> pa.Table:
    """(toxic, group, words) of at most so many toxic and clean labelled texts, the same ones
    each time, ordered by toxic and group.  Words are made where the texts are."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = marked.filter("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(marked.filter("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    # at most MOST_TOXIC + MOST_CLEAN ids, so this side is safe to broadcast at any size of the corpus
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_SIGNS), F.lit(1)))
    words = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    rows = rows.select("doc_id", "toxic", F.array_sort(words).alias("words"))
    # rows without words go after this, as a filter on words would move to the scan and make them of every text
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "words")).alias("r")).select("r.toxic", "r.words").filter(F.size("words") > 0)
    group = F.array_min(F.transform("words", lambda w: F.xxhash64(w)))
    return rows.select("toxic", group.alias("group"), "words").orderBy("toxic", "group", "words").toArrow()


def rows_of(sample: pa.Table) -> Iterator[Labelled]:
    """The rows of a sample one by one; only one is held as Python strings at a time."""
    for batch in sample.to_batches(max_chunksize=256):
        yield from zip(*(batch.column(k).to_pylist() for k in range(3)))


def _groups(rows: Iterable[Labelled]) -> Iterator[tuple[int, set[str]]]:
    """(toxic, folded words) of each group of near copies; rows come ordered by toxic and group."""
    for (toxic_, _), some in groupby(rows, key=lambda r: r[:2]):
        yield toxic_, set(fold(" ".join(set().union(*(r[2] for r in some)))).split())


def learn(sample: Callable[[], Iterable[Labelled]], shortest: int = 4, longest: int = 10, alpha: float = 0.01, known=None) -> tuple[tuple[str, float, bool], ...]:
    """The curated lexicon and the stems that mark toxic texts of the sample.

    A stem is a beginning of words that toxic texts have far more often than clean
    ones: 20 times as often, and by chance with probability ``alpha`` over all the
    beginnings tried.  Near copies count once: support is the number of groups.  Of
    beginnings with one support the longest stays, and of those, what extends another
    goes.  A curated entry that at least three clean groups have, and toxic ones hardly
    more often, is dropped; one that marks toxic texts as a stem must has a stem's weight
    if that is more.  ``sample`` gives the rows anew each time it is called.
    """
    known = tuple((fold(w), x, whole) for w, x, whole in (known if known is not None else default_lexicon()))
    curated = {w for w, _, _ in known}
    size: Counter[int] = Counter()
    found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for _, ws in _groups(r for r in sample() if r[0] == 1):
        size[1] += 1
        found[1].update({w[:k] for w in ws for k in range(shortest, min(longest, len(w)) + 1)} | ws & curated)
    tried = {p for p, n in found[1].items() if n >= 5}
    found[1] = Counter({p: n for p, n in found[1].items() if p in tried or p in curated})
    roots = {p[:shortest] for p in tried}
    for _, ws in _groups(r for r in sample() if r[0] == 0):
        size[0] += 1
        some = [w for w in ws if w[:shortest] in roots]
        found[0].update({w[:k] for w in some for k in range(shortest, min(longest, len(w)) + 1)} & tried | ws & curated)
    t, c = size[1], size[0]
    if not t or not c:
        return known

    def odds(p: str) -> float:
        return (found[1][p] + 0.5) / (t + 1) / ((found[0][p] + 0.5) / (c + 1))

    marks = lambda p: odds(p) >= 20 and math.erfc(math.sqrt(_g(found[1][p], found[0][p], t, c) / 2)) * len(tried) < alpha
    weight = lambda p: round(min(2.0, max(1.0, math.log(odds(p)) / 4)), 3)
    good = {p: found[1][p] for p in sorted(tried) if marks(p)}
    longer: dict[str, list[str]] = defaultdict(list)
    for p in good:
        longer[p[:-1]].append(p)
    closed = [p for p in good if not any(good[q] == good[p] for q in longer[p])]
    stems: list[tuple[str, float, bool]] = []
    for p in sorted(closed, key=lambda p: (len(p), p)):
        if not any(p.startswith(w) for w, _, _ in stems) and not any(w.startswith(p) for w in curated):
            stems.append((p, weight(p), False))
    weighed = ((w, max(x, weight(w)) if found[1][w] >= 5 and marks(w) else x, whole) for w, x, whole in known)
    return tuple(e for e in weighed if found[0][e[0]] < 3 or odds(e[0]) >= 3) + tuple(stems)


def _g(a: int, b: int, t: int, c: int) -> float:
    n, k = t + c, a + b
    g = 0.0
    for seen, row, col in ((a, t, k), (b, c, k), (t - a, t, n - k), (c - b, c, n - k)):
        if seen and row * col:
            g += seen * math.log(seen * n / (row * col))
    return max(0.0, 2 * g)


def trained_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[tuple[str, float, bool], ...]:
    """``learn`` on the bounded sample; the curated list alone where nothing is labelled."""
    sample = labelled_sample(docs, labels)
    return learn(lambda: rows_of(sample))
