"""Operators against brute force, SQL on small fixtures, round trips and held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontaminate, fingerprints, html_text, langid, line_dedup, ngram_join, pii, queries, toxicity
from lodestone.llm import textcore as tc
from tests.oracle import assert_same, views


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), views(sf_dir), queries.ORACLE_SQL[name])


# ---- PII ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay with card 4111 1111 1111 1111 now", ["card"]), ("pay with card 4111 1111 1111 1112 now", []), ("IBAN DE89 3704 0044 0532 0130 00.", ["iban"]), ("IBAN DE88 3704 0044 0532 0130 00.", []), ("write to jo.doe@mail.example.org!", ["email"]),
        ("host 10.0.0.12 answered", ["ipv4"]), ("firmware version 10.0.0.12", []), ("host 10.0.0.999", []), ("my social security number 123-45-6789", ["ssn"]), ("part 000-45-6789", []), ("call +49 30 1234 5678 today", ["phone"]), ("order 30 1234 5678", []),
        ("api_key = sk9f8a7b6c5d4e3f2a1b", ["secret"]), ("api_key = aaaaaaaaaaaaaaaa", []), ("nothing here", []), ("a@b @c d@", []),
    ],
)
def test_pii_spans(text, kinds):
    found = pii.spans(text)
    assert [k for k, *_ in found] == kinds
    assert pii.redact_text(text) == (text if not kinds else text[: found[0][1]] + f"[{kinds[0].upper()}]" + text[found[0][2] :])


def test_checksums_agree_with_arithmetic():
    r = random.Random(1)
    for _ in range(300):
        s = "".join(r.choice("0123456789") for _ in range(16))
        doubled = [int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s)]
        assert pii.luhn(s) == (sum(doubled) % 10 == 0)
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_pii_query_equals_row_by_row(spark, sf_dir, docs):
    want = sorted((r["doc_id"], *s) for r in docs.collect() for s in pii.spans(r["text"] or ""))
    assert sorted(map(tuple, queries.op1_pii(spark, sf_dir).collect())) == want and want


# ---- toxicity -----------------------------------------------------------------------------------


def _brute_hits(text, lexicon, exceptions):
    folded, text = " " + toxicity.fold(text), toxicity.plain(text)
    best, safe = {}, []
    for w, x, whole in [*lexicon, *((e, 0.0, True) for e in exceptions)]:
        at = folded.find(" " + w)
        while at >= 0:
            end = at + len(w)  # in the text
            if not (whole and end < len(text) and text[end].isalpha()):
                if not x:
                    safe.append((at, end))
                elif any(c.isalpha() for c in text[at:end]):
                    best[at] = max(x, best.get(at, 0))
            at = folded.find(" " + w, at + 1)
    best = {s: x for s, x in best.items() if not any(a <= s < b for a, b in safe)}
    return len(best), sum(best.values())


def test_hits_agree_with_search_of_each_entry(spark, sf_dir, docs):
    lexicon = toxicity.trained_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    automaton = toxicity._automaton(lexicon, toxicity.EXCEPTIONS)
    texts = [r["text"].lower() for r in docs.collect() if r["text"]] + ["you 1d10t, you ѕсum", "clown fish and class clowns", "a trash can, trash", "$tup1d stupid5", "idiot", "idiotproof", ""]
    for text in texts:
        n, x = toxicity.hits(text, automaton)
        m, y = _brute_hits(text, lexicon, toxicity.EXCEPTIONS)
        assert n == m and math.isclose(x, y)


@pytest.mark.parametrize("text, bad", [("you are a pathetic 1d10t and a m0r0n", True), ("уоu ѕtuріd ѕсum", True), ("the clown fish swam by the trash can", False), ("we all went home in the rain", False)])
def test_toxic_texts(text, bad):
    assert toxicity.score_text(text, toxicity._automaton(toxicity.default_lexicon(), toxicity.EXCEPTIONS))[4] is bad


def test_learned_stems_generalise():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghik") for _ in range(6))
    vocabulary = [word() for _ in range(300)]
    rows = []
    for k in range(400):
        ws = {r.choice(vocabulary) for _ in range(30)}
        rows.append((k % 2, k, sorted(ws | ({"zork" + r.choice(["en", "ed", "s"])} if k % 2 else set()))))
    rows.sort()
    lexicon = toxicity.learn(lambda: iter(rows))
    assert [e for e in lexicon if e[0].startswith("zork")] and len(lexicon) - len(toxicity.default_lexicon()) <= 3


# ---- language -----------------------------------------------------------------------------------


def test_language_on_rows_not_trained_on(spark, docs):
    train, held = docs.filter("pmod(xxhash64(doc_id), 3) > 0"), docs.filter("pmod(xxhash64(doc_id), 3) = 0 and n_chars > 200")
    net = langid.train(langid.sample(train))
    got = langid.identify(held, net).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) >= 0.85


def test_folded_tables_are_the_convolution():
    net = langid.Network(["a", "b"])
    net.fold()
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w in langid.WIDTHS:
        e = net.p["e"][x]
        a = np.stack([np.einsum("nke,kef->nf", e[:, i : i + w], net.p[f"f{w}"]) for i in range(x.shape[1] - w + 1)], 1) + net.p[f"b{w}"]
        pooled.append(np.maximum(0, a.max(1)))
    z = np.concatenate(pooled, 1) @ net.p["o"] + net.p["c"]
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.scores(x), want, atol=1e-4)


def test_gradients_agree_with_differences():
    net = langid.Network(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(2).integers(0, 256, (4, 40)), np.array([0, 1, 2, 1])

    def loss():
        net.fold()
        return -net.scores(x.astype(np.uint8))[np.arange(4), y].mean()

    g = net._gradients(x, y)
    for k in ("o", "c", "f3", "b2"):
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-2, abs_tol=1e-6)


# ---- fingerprints -------------------------------------------------------------------------------


def test_syncmers_agree_with_their_definition(spark, docs):
    k, s = 12, 4
    texts = [r["text"].lower()[:400] for r in docs.limit(20).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fingerprints.fingerprints(df, k, s).collect():
        code = np.array([ord(c) for c in texts[r["doc_id"]]], np.uint32)
        want = []
        for p in range(len(code) - k + 1):
            h = [int(fingerprints._smers(code[p + i : p + i + s], s)[0]) for i in range(k - s + 1)]
            if min(h) in (h[0], h[-1]):
                want.append(p)
        assert r["positions"] == want


def test_copied_passages_line_up(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(600)
    df = spark.createDataFrame([(1, text(100) + passage + text(50)), (2, text(333) + passage), (3, text(900))], "doc_id bigint, text string")
    f = fingerprints.fingerprints(df)
    found = [(x["doc_a"], x["doc_b"], x["shift"]) for x in fingerprints.matches(f, f).collect()]
    assert sorted(found) == [(2, 1, -233)]


# ---- chat ---------------------------------------------------------------------------------------


def _brute_step(before, after):
    start = next((k for k, (x, y) in enumerate(zip(before, after)) if x != y), min(len(before), len(after)))
    tail = next((k for k, (x, y) in enumerate(zip(before[start:][::-1], after[start:][::-1])) if x != y), min(len(before), len(after)) - start)
    return start, len(after) - tail, start + tail < len(before)


def test_chat_spans_agree_with_brute_force(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r["template"], r["conv_id"], r["turn"]): (r["start"], r["end"], r["rewrites"], r["n_chars"]) for r in queries.op5_chat_spans(spark, sf_dir).collect()}
    by_conv: dict[int, list] = {}
    for r in talks.orderBy("conv_id", "turn").collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    checked = 0
    for conv, turns in by_conv.items():
        messages = [{"role": t["role"] or "", "content": t["text"] or ""} for t in turns]
        for name, template in chat.TEMPLATES.items():
            if name == "strict":
                continue
            outputs = [template(messages[:k]) for k in range(len(turns) + 1)]
            steps = [(a, b, r and k > 0) for k, (a, b, r) in enumerate(_brute_step(a, b) for a, b in zip(outputs, outputs[1:]))]
            for k, t in enumerate(turns):
                a, b, rewrites = steps[k]
                lost = any(r and b > x for x, _, r in steps[k + 1 :])
                assert got[name, conv, t["turn"]] == ((None, None) if lost else (a, b)) + (rewrites, len(outputs[-1]))
                if not lost and name == "tagged":
                    assert messages[k]["content"] in outputs[-1][a:b]
                checked += 1
    assert checked * 5 == len(got) * 4


def test_rewriting_templates_are_told_apart(spark, sf_dir):
    seen = {r["template"]: r["any"] for r in queries.op5_chat_spans(spark, sf_dir).groupBy("template").agg(F.max("rewrites").alias("any")).collect()}
    assert seen == {"tagged": False, "closed": False, "recent": True, "defaulted": False, "strict": False}


def test_loss_mask():
    assert chat.loss_mask(6, [(1, 3), (5, 6)]).tolist() == [False, True, True, False, False, True]


# ---- decontamination ----------------------------------------------------------------------------


def _words(text):
    h, _, _, _ = tc.words(*tc.buffers(pa.array([text.lower()])))
    return h


def test_contamination_agrees_with_all_diagonals(spark, sf_dir, docs):
    items = [(r["item_id"], _words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d in docs.collect():
        h = _words(d["text"] or "")
        for i, w in items:
            if not len(np.intersect1d(h, w)):
                continue
            own: set[int] = set()
            for shift in range(1 - len(w), len(h)):
                a, b = max(0, -shift), min(len(w), len(h) - shift)
                same = w[a:b] == h[a + shift : b + shift]
                if same.sum() < decontaminate.LEAST_SEGMENT:
                    continue
                x, y = decontaminate.best_segment(same)
                good = np.flatnonzero(same[x:y]) + x + a
                if len(good) >= decontaminate.LEAST_SEGMENT:
                    own |= set(good.tolist())
            if len(own) >= min(decontaminate.LEAST_WORDS, math.ceil(decontaminate.LEAST_SHARE * len(w))):
                want.add((d["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontaminate(spark, sf_dir).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_substituted_words_are_tolerated(spark):
    r = random.Random(4)
    item = [f"term{r.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for k in range(40):
        ws = list(item)
        for at in range(r.randint(0, 4), 60, 6):
            ws[at] = f"other{r.randint(0, 10**6)}"
        rows.append((k, " ".join(["before"] * k + ws + ["after"] * k)))
    rows.append((99, " ".join(r.sample(item, 60))))
    docs_ = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontaminate.contamination(docs_, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {x["doc_id"] for x in found} == set(range(40))


# ---- line dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("least, lg_k", [(3, 9), (30, 4)])
def test_counts_of_sites_are_exact_near_the_threshold(spark, least, lg_k):
    rows, want = [], set()
    for line in range(120):
        sites = least - 3 + line % 7
        rows += [(1000 * line + k, f"line {line}", f"site{k}") for k in range(max(sites, 0)) for _ in range(1 + k % 2)]
        if sites >= least:
            want.add(f"line {line}")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").dropDuplicates(["doc_id"])
    got = {r["text"] for r in df.join(line_dedup.strip_lines(df, least, lg_k).filter("n_removed > 0").select("doc_id"), "doc_id").collect()}
    assert got == want


# ---- BPE ----------------------------------------------------------------------------------------


def test_tokens_and_bytes_come_back(spark, docs):
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ranks = spark.sparkContext.broadcast(bpe.load_ranks())
    for chunk, overlap in ((500, 64), (bpe.CHUNK, bpe.OVERLAP)):
        coded = bpe.encode(docs, chunk=chunk, overlap=overlap)
        for r in coded.select("doc_id", "tokens", "exact", bpe.decode(F.col("tokens"), ranks).alias("raw")).collect():
            assert r["exact"] and bytes(r["raw"]).decode() == texts[r["doc_id"]]
            assert r["tokens"] == plain.encode_ordinary(texts[r["doc_id"]])


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "x  " * 900, "\n\n \n" * 700, "don't we'll " * 200, "12345" * 500, "é😀　" * 600, "ab  \n  cd\t\t" * 300])
def test_awkward_texts_across_chunks(spark, text):
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), chunk=100, overlap=32).first()
    assert r["tokens"] == plain.encode_ordinary(text) and r["exact"]


def test_boundaries_are_the_pattern():
    assert bpe.boundaries("ab  cd", regex.compile(bpe.PATTERN)) == [0, 2, 3, 6] and bpe.boundaries("", regex.compile(bpe.PATTERN)) == [0]


# ---- n-gram join --------------------------------------------------------------------------------


def test_pairs_agree_with_brute_force(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 400)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([2, 5, 12, 60, 300]))]
        for _ in range(r.randint(1, 6)):
            ws = [word() if r.random() < r.choice([0, 0.02, 0.1]) else w for w in base]
            rows.append((len(rows), " ".join(ws)))
    rows += [(1000 + k, "the same three words here and there and more " * 3) for k in range(30)]
    grams = {}
    for k, x in rows:
        ws = x.split()
        grams[k] = {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} or {tuple(ws)}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b]) - 1e-9}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    named, pairs = ngram_join.pairs(df)
    sets = {}
    for x in named.collect():
        sets.setdefault(x["set"], []).append(x["doc_id"])
    got = {(min(a, b), max(a, b)): x["jaccard"] for x in pairs.collect() for a in sets[x["set_a"]] for b in sets[x["set_b"]]}
    got |= {(a, b): 1.0 for ids in sets.values() for a in ids for b in ids if a < b}
    assert set(got) == want
    assert all(math.isclose(j, len(grams[a] & grams[b]) / len(grams[a] | grams[b]), abs_tol=1e-6) for (a, b), j in got.items())
    parent = {k: k for k in grams}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {x["doc_id"] for x in ngram_join.one_of_each(df).collect()} == {root(k) for k in grams}
    links = {k: sum(k in p for p in want) for k in grams}
    assert sorted(tuple(x) for x in ngram_join.near_duplicates(df).collect()) == sorted((k, root(k), links[k]) for k in grams)


def test_links_are_counted_in_blocks_and_for_hot_sets(spark, monkeypatch):
    r = random.Random(3)
    base = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(f"x{k}" if j == k % 60 else w for j, w in enumerate(base))) for k in range(40)]
    rows += [(100 + k, " ".join(base)) for k in range(1200)] + [(5000 + k, " ".join(f"u{r.randint(0, 9**9)}" for _ in range(40))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 200)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 500)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(df).collect()}
    assert got == {i: (0, 1239) if i < 5000 else (i, 0) for i, _ in rows}


def test_a_large_cluster_keeps_its_links_without_a_row_for_each_pair(spark, monkeypatch):
    r = random.Random(12)
    base = [f"c{k}" for k in range(120)]
    rows = [(k, " ".join(f"o{k}x{j}" if r.random() < 0.055 else w for j, w in enumerate(base))) for k in range(500)]
    grams = [{*zip(ws, ws[1:], ws[2:])} for ws in (x.split() for _, x in rows)]
    near = [[y for y in range(500) if x != y and (o := len(grams[x] & grams[y])) >= 0.5 * (len(grams[x]) + len(grams[y]) - o) - 1e-9] for x in range(500)]
    first = {}
    for k in range(500):
        todo = [k] if k not in first else []
        while todo:
            if first.setdefault(x := todo.pop(), k) == k:
                todo += [y for y in near[x] if y not in first]
    assert 30_000 < sum(map(len, near)) / 2 < 120_000  # neither none nor all of them
    written, save = [], ngram_join.checkpointed

    def counted(df):
        written.append((kept := save(df)).count())
        return kept

    monkeypatch.setattr(ngram_join, "checkpointed", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(df).collect()))
    assert got == [(k, first[k], len(near[k])) for k in range(500)]
    assert max(written) < 10 * len(rows)


def test_a_doc_id_with_several_texts_has_a_row_for_each(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (2, b), (3, None), (None, "x y z")], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 0), (None, None, 0)]


# ---- HTML ---------------------------------------------------------------------------------------

PAGE = """<html><head><title>A &amp; B</title><style>p {}</style></head><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li><li><a href=z>About us</a></li></ul>
<h1>What the river brought this spring to the old town</h1><p>{0}</p><p>{1}</p><script>var x = "<p>no</p>";</script><div><a href=q>Next</a></div><div>Copyright 2020 all rights reserved</div></body></html>"""


def test_content_is_kept_and_navigation_dropped():
    one, two = " ".join(f"alpha{k}" for k in range(60)), " ".join(f"beta{k}" for k in range(45))
    text, n, good = html_text.extract_text(PAGE.replace("{0}", one).replace("{1}", two))
    assert text.split("\n") == ["What the river brought this spring to the old town", one, two] and (n, good) == (8, 3)
    assert html_text.title(PAGE) == "A & B"


def test_the_tree_generalises_over_the_labelled_table():
    table = np.array(html_text.LABELLED, float)
    right = 0
    for k in range(len(table)):
        rest = np.delete(table, k, 0)
        right += html_text.classify(html_text.grow(rest[:, :-1], rest[:, -1]), table[k : k + 1, :-1])[0] == bool(table[k, -1])
    assert right / len(table) >= 0.85


def test_html_query_equals_row_by_row(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op10_html_text(spark, sf_dir).collect()
    assert {r["page_id"]: (r["text"], r["n_blocks"], r["n_content"]) for r in rows} == {k: html_text.extract_text(x) for k, x in pages.items()}
