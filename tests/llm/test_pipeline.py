"""The pipeline against plain Python, stage by stage, on a small table with all cases planted."""

from __future__ import annotations

import random

import pytest
import tiktoken

import corpus_pipeline as pipeline
from lodestone.llm import bpe, decontaminate, toxicity

BOILER = "Subscribe to our letter for more of the same every week"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [prose(40) for _ in range(5)]
    rows = [(k, prose(r.choice([3, 30, 120])), f"s{k % 5}") for k in range(40)]
    rows += [(100 + k, f"{BOILER}\n{prose(50)}", f"s{k}") for k in range(5)] + [(110, BOILER, "s1"), (111, f"  {BOILER.upper()} \n\n{BOILER}", "s2")]
    base = prose(80).split()
    for k in range(4):
        near = list(base)
        near[7 * k] = "changed"
        rows.append((120 + k, " ".join(near), f"s{k}"))
    rows += [(130 + k, rows[3][1], "s0") for k in range(30)]
    rows += [(170 + k, prose(20) + " " + items[k] + " " + prose(20), "s4") for k in range(5)]
    rows += [(180, "you pathetic 1d10t moron " + prose(30), "s1"), (181, "ѕсum and vermin " + prose(30), "s2"), (182, "the clown fish and the trash can " + prose(30), "s3")]
    rows += [(190, None, "s1"), (191, "", "s1"), (None, prose(30), None), (192, prose(30000), "s2")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(180, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _key(r):
    return (r[0] is None, r[0] or 0)


def _brute(rows, items):
    automaton = toxicity._automaton(toxicity.default_lexicon(), toxicity.EXCEPTIONS)
    rows = [r for r in rows if not toxicity.score_text(None if r[1] is None else r[1].lower(), automaton)[4]]
    sites, first = {}, {}
    for i, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if k := line.lower().strip(" "):
                sites.setdefault(k, set()).update({site} - {None})
                at = (i is None, i or 0, pos)
                first[k] = min(first.get(k, at), at)
    out = []
    for i, text, site in rows:
        if text is not None:
            gone = {p for p, line in enumerate(text.split("\n")) if (k := line.lower().strip(" ")) and len(sites[k]) >= 3 and first[k] != (i is None, i or 0, p)}
            left = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
            if gone and not left.strip():
                continue
            text = left
        out.append((i, text, site))
    rows = sorted(out, key=_key)
    grams, root = [], list(range(len(rows)))
    for _, text, _ in rows:
        ws = (text or "").lower().split()
        grams.append({tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} or ({tuple(ws)} if ws else set()))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if grams[a] and len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b]) - 1e-9:
                root[max(top(a), top(b))] = min(top(a), top(b))
    rows = [r for k, r in enumerate(rows) if top(k) == k]
    rows = [r for r in rows if not any(x in (r[1] or "") for x in items)]
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    return [(i, None if t is None else plain.encode_ordinary(t), None if t is None else len(t)) for i, t, _ in rows]


def test_pipeline_agrees_with_plain_python(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = sorted(_brute(rows, items), key=_key)
    got = pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], r["tokens"], r["n_chars"]) for r in got.collect()), key=_key) == want
    ids = {r[0] for r in want}
    assert {182, 192, 190, 191, None, 100, 120} <= ids and not ids & {180, 181, 110, 121, 130, 170}


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != "bpe":
            assert out.dtypes == docs.dtypes
    assert decontaminate.clean_only(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == docs.count() - 5
