from __future__ import annotations

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.operators import index, makefile, merge, search, store
from lodestone.plans import corpus, engine
from lodestone.sources import packages, quicklisp, specs
from lodestone.streaming import ingest


def _docs(spark, *bodies):
    return spark.createDataFrame([(k, f"f{k}", b) for k, b in enumerate(bodies)], "doc_id bigint, filename string, body string")


def _naive(body: str, q: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in range(len(body) - len(q) + 1):
        if body[p : p + len(q)] == q:
            if out and p <= out[-1][1]:
                out[-1][1] = p + len(q)
            else:
                out.append([p, p + len(q)])
    return [tuple(x) for x in out]


def _spans(df):
    return sorted((r["doc_id"], r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize(
    "body, q, spans",
    [("defundefun xdefun", "defun", [(0, 10), (12, 17)]), ("ababa", "aba", [(0, 5)]), ("xaaaaax", "aaaa", [(1, 6)]), ("abc bcd", "abcd", []), ("ab\ncd", "b\nc", [(1, 4)]), ("é😀éé😀é", "é😀é", [(0, 6)])],
)
def test_phrases_by_scan_and_by_index(spark, body, q, spans):
    docs = _docs(spark, body, None, "")
    want = [(0, a, b) for a, b in spans]
    assert _spans(search.scan_phrase(docs, q)) == want
    assert _spans(search.index_phrase(index.postings(docs), docs, q)) == want


def test_random_phrases_agree_with_a_naive_search(spark):
    r = random.Random(5)
    bodies = ["".join(r.choice("ab\n") for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = _docs(spark, *bodies).cache()
    postings = index.postings(docs).cache()
    for q in ("aba", "aaaa", "b\nb", "abab", "bbbbb"):
        want = sorted((k, a, b) for k, x in enumerate(bodies) for a, b in _naive(x, q))
        assert _spans(search.scan_phrase(docs, q)) == want
        assert _spans(search.index_phrase(postings, docs, q)) == want


def test_short_phrases_are_refused(spark):
    docs = _docs(spark, "abc")
    for f in (lambda: search.scan_phrase(docs, "ab"), lambda: search.match_positions(index.postings(docs), "")):
        with pytest.raises(ValueError):
            f()


def test_postings_agree_with_explode(spark, sf_dir):
    docs = corpus.document(spark, sf_dir).select("doc_id", "body")
    slow = index.tokenize(docs).groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    fast = index.postings(docs)
    assert fast.count() == slow.count() == fast.intersect(slow).count()


def test_out_of_order_lists_are_found(spark):
    lists = spark.createDataFrame([("ok ", [(1, [1, 2]), (2, [0])]), ("doc", [(2, [0]), (1, [0])]), ("pos", [(1, [2, 1])])], "term string, postings array<struct<doc_id: bigint, positions: array<int>>>")
    assert sorted(r[0] for r in index.out_of_order(lists).collect()) == ["doc", "pos"]


def test_insert_if_absent_keeps_what_is_there(spark):
    kept = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, index.insert_if_absent(kept, new, "k").collect())) == [("a", 1), ("b", 3)]


def _filename_postings(relations):
    at = relations["inverted_index"].join(relations["document"].select("doc_id", "filename"), "doc_id")
    return sorted((r["term"], r["filename"], tuple(r["positions"])) for r in at.select("term", "filename", "positions").collect())


def test_merged_shards_equal_one_index(spark, sf_dir):
    docs = corpus.document(spark, sf_dir).filter("doc_id < 40").cache()
    whole = corpus.relations(docs)
    parts = []
    for k in range(3):
        some = corpus.relations(docs.filter(F.col("doc_id") % 3 == k))
        local = docs.filter(F.col("doc_id") % 3 == k).select("doc_id", F.expr(f"cast((doc_id - {k}) / 3 + 1 as bigint)").alias("new"))
        for name in ("document", "inverted_index", "symbol_definition", "package_definition", "asd_system"):
            r = some[name]
            some[name] = r.join(local, "doc_id").drop("doc_id").withColumnRenamed("new", "doc_id").select(r.columns)
        parts.append(some)
    one = merge.merged(parts)
    assert _filename_postings(one) == _filename_postings(whole)
    ids = sorted(r[0] for r in one["document"].select("doc_id").collect())
    assert ids == list(range(1, 41))
    names = lambda r: sorted(map(tuple, r["symbol_definition"].join(r["document"].select("doc_id", "filename"), "doc_id").select("symbol_id", "filename", "position").collect()))
    assert names(one) == names(whole)


def test_unknown_documents_become_zero(spark):
    document = spark.createDataFrame([(0, 5, "a", "x")], "shard int, doc_id bigint, filename string, body string")
    rows = spark.createDataFrame([(0, "s", "X", 5, 1), (0, "s", "X", 9, 2)], "shard int, symbol_id string, specifier string, doc_id bigint, position int")
    assert sorted(r["doc_id"] for r in merge.pointing(rows, merge.id_map(document)).collect()) == [0, 1]


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "p.asd").write_text('(defsystem "p")\n')
    (root / "src/a.lisp").write_text("(defpackage :p (:use :cl))\n(in-package #:p)\n(defun is (x) x)\n")
    loc = lambda s, at: {"specifier": s, "file": str(root / "src/a.lisp"), "position": at}
    spec = {
        "system_name": "p", "asd_file": str(root / "p.asd"), "root_directory": str(root), "files": [str(root / "src/a.lisp"), str(root / "src/missing.lisp")], "time": 2.5,
        "definitions": [
            {"identifier": {"type": "package", "name": "P"}, "locations": [loc("DEFPACKAGE", 0)]}, {"identifier": {"type": "symbol", "name": "IS", "package": "P"}, "locations": [loc("DEFUN", 45), {"specifier": "DEFUN", "file": "/else", "position": 3}]},
            {"identifier": {"type": "symbol", "name": "BODY", "package": "P"}, "locations": []}, {"identifier": {"type": "symbol", "name": "NOPLACE"}, "locations": [{"specifier": "DEFUN", "file": None, "position": None}]},
        ],
    }
    path = tmp_path / "p.json"
    path.write_text(json.dumps(spec))
    (tmp_path / "bad.json").write_text("{not json")
    return tmp_path


def test_specs_are_read_and_bad_ones_set_aside(spark, project):
    good, bad = specs.read(spark, str(project / "p.json"), str(project / "bad.json"))
    assert [r["system_name"] for r in good.collect()] == ["p"]
    assert [r["spec_file"] for r in bad.select("spec_file").collect()] == [str(project / "bad.json")]


def test_index_merge_and_search(spark, project):
    out, both = str(project / "p.index"), str(project / "both.index")
    assert engine.index_specs(spark, [str(project / "p.json"), str(project / "bad.json")], out).count() == 1
    r = store.attach(spark, out, "t_")
    assert sorted(map(tuple, r["document"].select("doc_id", "filename").collect())) == [(1, "p.asd"), (2, "src/a.lisp"), (3, "src/missing.lisp")]
    assert spark.sql("select count(*) from t_symbol").first()[0] == 3
    assert sorted((x["doc_id"], x["position"]) for x in r["symbol_definition"].collect()) == [(0, 3), (2, 45)]
    found = engine.search_store(r, ["defun", "def"], symbol="p:is", file="a.lisp")
    assert sorted((x["query_no"], x["doc_id"], x["start"]) for x in found.collect() if x["query_no"] < 2) == [(0, 0, 3), (0, 2, 45), (1, 2, 0)]
    lines = [x[0] for x in engine.printed(found, r["document"]).collect()]
    assert lines == ["src/a.lisp:45:45:(defun is (x) x)", "src/a.lisp:0:0:(defpackage :p (:use :cl))", "src/a.lisp:45:50:(defun is (x) x)", 'p.asd:1:4:(defsystem "p")', "src/a.lisp:1:4:(defpackage :p (:use :cl))", "src/a.lisp:45:48:(defun is (x) x)"]
    assert engine.search_store(r, symbol="body").count() == 0
    assert sorted((x["system_name"] or "", x["status"]) for x in spark.read.parquet(f"{out}/status").collect()) == [("", "failure"), ("p", "success")]
    engine.merge_stores(spark, [out, out], both)
    m = store.read(spark, both)
    assert m["document"].count() == 6 and m["token"].count() == r["token"].count() and m["inverted_index"].count() == 2 * r["inverted_index"].count()
    with pytest.raises(ValueError):
        engine.search_store(r)


def test_unknown_kinds_of_definition_fail(spark, project):
    spec = json.loads((project / "p.json").read_text())
    spec["definitions"][0]["identifier"]["type"] = "odd"
    (project / "p.json").write_text(json.dumps(spec))
    with pytest.raises(Exception, match="no such kind"):
        engine.index_specs(spark, [str(project / "p.json")], str(project / "x.index"))


def test_commands(spark, project, capsys):
    assert main(["index", "-o", str(project), str(project / "p.json")]) == 0
    assert main(["merge", "-o", str(project / "m.index"), str(project / "p.index")]) == 0
    capsys.readouterr()
    assert main(["search", "-d", str(project / "m.index"), "defun", "-s", "is"]) == 0
    assert capsys.readouterr().out.splitlines() == ["src/a.lisp:45:45:(defun is (x) x)", "src/a.lisp:45:50:(defun is (x) x)"]
    assert main(["search", "-d", str(project / "none"), "defun"]) == 1
    with pytest.raises(SystemExit):
        main(["search", "-d", str(project / "m.index")])


def test_lists_of_systems_and_releases(spark, tmp_path):
    (tmp_path / "systems.txt").write_text("# project system-file system-name [dependency1..dependencyN]\np f a/b x y/z\np f c\n")
    (tmp_path / "releases.txt").write_text("# project url size file-md5 content-sha1 prefix [system-file1..N]\np u 1 m c old f.asd\np u 2 m c p-2 src/f.asd g.asd\nq u 3 m c q-1\n")
    s = quicklisp.systems(spark, str(tmp_path / "systems.txt"))
    assert [(r["system_name"], r["dependencies"]) for r in s.orderBy("no").collect()] == [("a/b", ["x", "y/z"]), ("c", [])]
    assert quicklisp.listed_systems(spark, str(tmp_path / "systems.txt")).count() == 2
    rel = quicklisp.releases(spark, str(tmp_path / "releases.txt"))
    assert sorted((r["project"], r["prefix"], tuple(r["system_files"])) for r in rel.collect()) == [("p", "p-2", ("src/f.asd", "g.asd")), ("q", "q-1", ())]
    assert sorted(map(tuple, quicklisp.system_files(s, rel, "d/").collect())) == [("a/b", "d/p-2/src/f.asd"), ("c", "d/p-2/src/f.asd")]
    text = makefile.makefile(s, "dist/", "a/", "i/").first()[0]
    assert text.startswith("all: a/a_b.json \\\n     a/c.json \\\n     i/a_b.db \\\n     i/c.db\n\nanalyze: ")
    assert "\na/a_b.json: a/x.json a/y_z.json\n\tanalyze a/b dist/ a/a_b.json\n" in text and text.endswith("i/c.db: a/c.json\n\tindex a/c.json i/c.db\n")


def test_package_forms():
    text = '; (defpackage :no)\n(defpackage :one (:use :cl))\n(uiop:define-package #:two)\n(progn (defpackage :inner))\n(cl:defpackage "Three")\n#|(defpackage :no)|#'
    assert [(h, n) for h, n, _ in packages.forms(text)] == [("defpackage", "ONE"), ("uiop:define-package", "TWO"), ("cl:defpackage", "Three")]


def test_streamed_documents_are_added_once(spark, tmp_path):
    out, folder = str(tmp_path / "s.index"), str(tmp_path / "in")
    store.create(spark, out)
    docs = _docs(spark, "abcd", "bcde")
    docs.filter("doc_id = 0").write.parquet(folder)
    for k in range(2):
        ingest.ingest(ingest.arriving(spark, folder), out, str(tmp_path / "c")).awaitTermination()
        docs.write.mode("append").parquet(folder)
    ingest.ingest(ingest.arriving(spark, folder), out, str(tmp_path / "c")).awaitTermination()
    r = store.read(spark, out)
    assert sorted(x[0] for x in r["document"].select("doc_id").collect()) == [0, 1]
    assert sorted(x[0] for x in r["token"].select("term").collect()) == ["abc", "bcd", "cde"]
    assert r["inverted_index"].count() == 4


def test_a_batch_that_runs_again_adds_nothing_twice(spark, tmp_path):
    out, folder = str(tmp_path / "s.index"), str(tmp_path / "in")
    store.create(spark, out)
    _docs(spark, "abcd", "bcde").write.parquet(folder)
    read = lambda: {n: sorted(map(str, r.collect())) for n, r in store.read(spark, out).items()}
    ingest.ingest(ingest.arriving(spark, folder), out, str(tmp_path / "c")).awaitTermination()
    done = read()
    assert len(done["document"]) == 2 and len(done["token"]) == 3
    # the batch's last step is lost, and the stream forgets that it was done
    (part,) = [p for p in (tmp_path / "s.index/document").iterdir() if p.is_dir()]
    shutil.rmtree(part)
    shutil.rmtree(tmp_path / "c/commits")
    ingest.ingest(ingest.arriving(spark, folder), out, str(tmp_path / "c")).awaitTermination()
    assert read() == done


def test_shards_with_gaps_are_numbered_anew(spark):
    rows = [(0, 5, "a", "x"), (0, 9, "b", "y"), (1, 1, "c", "z")]
    document = spark.createDataFrame(rows, "shard int, doc_id bigint, filename string, body string")
    for some, want in ((document, {("a", 1), ("b", 2), ("c", 3)}), (document.filter("shard = 1"), {("c", 1)})):
        ids = merge.id_map(some)
        assert {(r["filename"], r["doc_id"]) for r in merge.documents(some, ids).collect()} == want
        assert {(r["filename"], r["doc_id"]) for r in merge.described(some, ids).collect()} == want
    dense = spark.createDataFrame([(3, 1, "a", "x"), (3, 2, "b", "y"), (7, 1, "c", "z")], document.schema)
    ids = merge.id_map(dense)
    assert "before" in ids.columns
    at = spark.createDataFrame([(3, "s", "X", 2, 1), (7, "s", "X", 1, 1), (7, "s", "X", 2, 1), (9, "s", "X", 1, 1), (3, "s", "X", None, 1)], "shard int, symbol_id string, specifier string, doc_id bigint, position int")
    assert sorted(r["doc_id"] for r in merge.pointing(at, ids).collect()) == [0, 0, 0, 2, 3]
