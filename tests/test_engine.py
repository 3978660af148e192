import json
import os
import random
import threading
import urllib.request
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom.cache import ResponseCache
from termloom.cli import main
from termloom.config import Config, load_config
from termloom.engine import Engine
from termloom.evaluate import per_query, percentile, summary
from termloom.functions.ids import fnv1a64
from termloom.http import make_server, respond
from termloom.functions.analyze import STOP_WORDS
from termloom.operators.index import Delta, build_index
from termloom.plans.query import QueryParseError
from termloom.sources.directory import _read_local, scan_directory
from termloom.sources.evalset import read_evaluation
from termloom.sources.synthetic import synthetic_corpus
from termloom.sources.tables import corpus_from_table
from termloom.store import IndexLoadError, current_version, load_index, save_index, update_index
from termloom.streaming.ingest import upsert_stream


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "ml.md").write_text("# Introduction to Machine Learning\n\nMachine learning builds models from data.")
    (root / "db.MD").write_text("# Databases\n\nA database stores rows; a database has tables in PostgreSQL.")
    (root / "sub" / "deep one.txt").write_text("Deep learning is a kind of machine learning")
    (root / "page.html").write_text("machine")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(index_path=str(tmp_path / "index")))


def test_scan(spark, corpus):
    rows = {r["path"]: r for r in scan_directory(spark, str(corpus)).collect()}
    assert sorted(rows) == [f"{corpus}/db.MD", f"{corpus}/ml.md", f"{corpus}/sub/deep one.txt"]
    r = rows[f"{corpus}/ml.md"]
    assert r["doc_id"] == fnv1a64(f"{corpus}/ml.md") and r["modified_time"] == int((corpus / "ml.md").stat().st_mtime)
    with pytest.raises(FileNotFoundError):
        scan_directory(spark, str(corpus / "none"))


def test_unreadable_files_are_reported(spark, corpus, engine):
    files = spark.createDataFrame([(str(corpus / "db.MD"),), (str(corpus / "gone.md"),), (str(corpus / "sub"),)], "f string")
    read = files.select("f", _read_local(F.col("f")).alias("r")).select("f", "r.*").collect()
    assert {Path(r["f"]).name: (r["raw"] is None, r["error"]) for r in read} == {
        "db.MD": (False, None), "gone.md": (True, "No such file or directory"), "sub": (True, "Is a directory")
    }
    (corpus / "bad.md").write_bytes(b"caf\xe9 ok")
    engine.index_directory(str(corpus))
    assert engine.search("ok").total_candidates == 1


def test_all_errors_are_counted_and_listed(spark, corpus, engine, monkeypatch, tmp_path, capsys):
    def scan(spark, root, with_content=True):
        ids = spark.range(1200).select(F.concat(F.lit("bad"), "id").alias("doc_id"), F.concat(F.lit("bad/"), "id", F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("modified_time"))
        if with_content:
            ids = ids.withColumns({"raw": F.lit(None).cast("binary"), "error": F.lit("Permission denied")})
        return scan_directory(spark, root, with_content).unionByName(ids)

    monkeypatch.setattr("termloom.engine.scan_directory", scan)
    for added, unchanged in ((3, 0), (0, 3)):  # a full run, an incremental one
        r = engine.index_directory(str(corpus))
        assert (r.found, r.added, r.updated, r.unchanged, r.errors) == (1203, added, 0, unchanged, 1200)
        assert {tuple(x) for x in r.error_rows.select("path", "error").collect()} == {(f"bad/{i}.md", "Permission denied") for i in range(1200)}
        assert len(r.error_details) == 1000 and r.error_details[0] == ("bad/0.md", "Permission denied")
    assert main(["--index", str(tmp_path / "cli"), "index", str(corpus)], spark) == 1
    assert capsys.readouterr().out.count("Permission denied") == 1200


def test_index_search_and_reindex(engine, corpus):
    r = engine.index_directory(str(corpus))
    assert (r.found, r.added, r.errors) == (3, 3, 0)
    found = engine.search("database")
    assert found.total_candidates == 1 and found.results[0].title == "Databases" and "<mark>Database</mark>" in found.results[0].snippet
    assert not found.cache_hit and engine.search("database").cache_hit
    assert engine.search("learning OR database", top=1).total_candidates == 3 and len(engine.search("learning OR database", top=1).results) == 1
    with pytest.raises(QueryParseError):
        engine.search("machine AND")
    r = engine.index_directory(str(corpus))
    assert (r.added, r.updated, r.deleted, r.unchanged) == (0, 0, 0, 3)
    (corpus / "db.MD").unlink()
    (corpus / "ml.md").write_text("# Changed\n\nvectors")
    os.utime(corpus / "ml.md", (1, 1))
    r = engine.index_directory(str(corpus))
    assert (r.added, r.updated, r.deleted, r.unchanged) == (0, 1, 1, 1)
    assert engine.search("database").results == () and engine.search("vectors").results[0].title == "Changed"
    for q, n in (("nothing", 0), ("the", 0), ("NOT nothing", 2), ('"kind of machine"', 1), ("vectors OR learning", 2)):
        assert engine.search(q).total_candidates == n, q
        assert [x.document_id for x in engine.search(q).results] == [r["doc_id"] for r in engine.results(q).collect()]
    s = engine.stats()
    assert s.documents == 2 and s.cache_hits == 7
    assert engine.get_document(fnv1a64(f"{corpus}/ml.md"))["token_count"] == 2 and engine.get_document("x") is None
    assert engine.contains(fnv1a64(f"{corpus}/ml.md")) and engine.document_ids().count() == 2 and engine.postings_for("vector").count() == 1
    many = engine.search_many({"q1": "vectors", "q2": "learning"})
    assert {r["query"] for r in many.collect()} == {"q1", "q2"}


def test_empty_engine_and_clamp(engine):
    assert engine.search("anything").results == ()
    assert [engine.clamp(k) for k in (None, 0, 5, 1000, -1)] == [10, 10, 5, 100, 10]
    assert not engine.load_if_present()


def test_store(spark, tmp_path):
    path = str(tmp_path / "ix")
    with pytest.raises(IndexLoadError):
        load_index(spark, path)
    ix = build_index(spark.createDataFrame([("a", "a", "t", "machine learning machine", 1)], "doc_id string, path string, title string, content string, modified_time bigint"))
    folder = save_index(ix, path)
    got = load_index(spark, path)
    assert got.stats.first()["n_docs"] == 1 and got.postings.where(F.col("term") == "machine").first()["tf"] == 2
    assert not [x for x in os.listdir(path) if x.startswith("_CURRENT.")]
    Path(folder, "_META.json").write_text('{"format": "termloom-index", "version": 999}')
    with pytest.raises(IndexLoadError, match="999"):
        load_index(spark, path)
    Path(folder, "_META.json").write_text("{")
    with pytest.raises(IndexLoadError):
        load_index(spark, path)
    for _ in range(3):
        save_index(ix, path)
    assert len([x for x in os.listdir(path) if x.startswith("v=")]) == 2 and current_version(spark, path).startswith("v=4-")
    for f in Path(path, current_version(spark, path), "terms").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    with pytest.raises(IndexLoadError):
        load_index(spark, path).terms.count()


def _bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_an_update_writes_what_changes(spark, tmp_path):
    path, words = str(tmp_path / "ix"), [f"w{i}" for i in range(500)]
    rnd = random.Random(1)
    rows = {f"d{i}": " ".join(rnd.choices(words, k=80)) for i in range(400)}
    frame = lambda r: corpus_from_table(spark.createDataFrame(sorted(r.items()), "id string, text string"), "id", "text")
    whole = _bytes(save_index(build_index(frame(rows)), path))

    def change(fresh, gone):
        ids = spark.createDataFrame([(g,) for g in gone], "doc_id string")
        return update_index(spark, path, Delta(frame(fresh), ids), STOP_WORDS)

    def same():
        got, want = load_index(spark, path), build_index(frame(rows))
        for part in ("postings", "terms"):
            a, b = getattr(got, part), getattr(want, part)
            assert a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty(), part
        assert tuple(got.stats.first()) == tuple(want.stats.first())
        assert sorted(r["doc_id"] for r in got.docs.collect()) == sorted(rows)

    for fresh, gone in (({"d7": "w1 w2 fresh"}, []), ({"x": "new w3"}, ["d8", "none"]), ({"d7": "w1 again"}, ["x"]), ({"x": "back w9"}, [])):
        written = _bytes(change(fresh, gone))
        rows = {k: v for k, v in rows.items() if k not in gone} | fresh
        assert written < whole / 3
        same()
    names = [s["name"] for s in json.loads(Path(path, current_version(spark, path), "_META.json").read_text())["segments"]]
    assert len(names) < 4 and set(names) <= set(os.listdir(path))
    change({}, [f"d{i}" for i in range(100, 300)])
    rows = {k: v for k, v in rows.items() if not (k[0] == "d" and 100 <= int(k[1:]) < 300)}
    same()
    assert len(json.loads(Path(path, current_version(spark, path), "_META.json").read_text())["segments"]) == 1


def test_cache():
    c = ResponseCache(2)
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("c") == 3 and (c.hits, c.misses, len(c)) == (2, 1, 2)
    c.put("c", 4)
    assert c.get("c") == 4
    c.invalidate_all()
    assert len(c) == 0 and c.get("a") is None


def test_config(tmp_path):
    (f := tmp_path / "x.conf").write_text("# c\nbm25.k1 = 2.0 # more\nunknown = 1\nport=9\nno line\ndefault_ranker = tfidf\n")
    assert load_config(str(f)) == replace(Config(), k1=2.0, port=9, default_ranker="tfidf")
    assert load_config(str(tmp_path / "none")) == Config()


def test_cli(spark, corpus, tmp_path, capsys):
    base = ["--index", str(tmp_path / "cli"), "--config", "none"]
    assert main([*base, "search", "x"], spark) == 1
    assert main([*base, "index", str(corpus)], spark) == 0
    assert main([*base, "search", "machine learning", "--top", "1", "--ranker", "tfidf"], spark) == 0
    assert main([*base, "search", "x AND"], spark) == 1
    assert main([*base, "stats"], spark) == 0 and main([*base, "save"], spark) == 0
    assert main([*base, "index", str(corpus / "none")], spark) == 1
    out = capsys.readouterr().out
    assert "added 3" in out and "documents 3" in out


def test_http(engine, corpus):
    assert respond(engine, "GET", "/health") == (200, {"status": "ok"})
    assert respond(engine, "POST", "/index", b"{}")[0] == 400 and respond(engine, "POST", "/index", b"nope")[0] == 400
    assert respond(engine, "POST", "/index", json.dumps({"path": str(corpus)}).encode())[1]["documents_indexed"] == 3
    assert respond(engine, "POST", "/index", b'{"path": "/none/here"}')[0] == 400
    assert respond(engine, "GET", "/search")[0] == 400 and respond(engine, "GET", "/search?q=x+AND")[0] == 400
    status, out = respond(engine, "GET", "/search?q=machine%20learning&top_k=zz&ranker=tfidf")
    assert status == 200 and out["total_candidates"] == 2 and out["ranker"] == "tfidf"
    doc = fnv1a64(f"{corpus}/ml.md")
    assert respond(engine, "GET", f"/documents/{doc}")[1]["title"] == "Introduction to Machine Learning"
    assert respond(engine, "GET", "/documents/zz")[0] == 404 and respond(engine, "GET", "/none")[0] == 404
    assert respond(engine, "GET", "/stats")[1]["documents"] == 3
    server = make_server(engine, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as r:
        assert json.load(r) == {"status": "ok"}
    server.shutdown()
    server.server_close()


def test_evaluation(spark, tmp_path):
    (f := tmp_path / "e.json").write_text('[{"query": "a", "relevant": ["x.md", "y.md"]}, {"query": "b", "relevant": []}]')
    judged = read_evaluation(spark, str(f), "root/")
    rows = {r["query"]: r for r in judged.collect()}
    assert set(rows["a"]["relevant"]) == {fnv1a64("root/x.md"), fnv1a64("root/y.md")} and rows["b"]["relevant"] == []
    ranked = spark.createDataFrame([("a", 1, "no"), ("a", 2, fnv1a64("root/x.md")), ("a", 7, fnv1a64("root/y.md"))], "query string, rank int, doc_id string")
    got = {r["query"]: tuple(r)[1:] for r in per_query(ranked, judged).collect()}
    assert got == {"a": (0.2, 1.0, 0.5), "b": (0.0, 0.0, 0.0)}
    assert tuple(summary(ranked, judged).first()) == (2, 0.1, 0.5, 0.25)
    v = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert percentile(v, "x", 0.5).first()[0] == 4.0 and percentile(v, "x", 0.99).first()[0] == 8.0


def test_published_relevance(spark, tmp_path):
    """Precision@5, Recall@10 and MRR of the labelled corpus of 25 documents and 33 queries, with both rankers.

    EVAL_CORPUS names its folder and EVAL_QUERIES the JSON file; without them the test is skipped.
    """
    corpus, queries_file = os.environ.get("EVAL_CORPUS"), os.environ.get("EVAL_QUERIES")
    if not corpus or not queries_file:
        pytest.skip("no labelled corpus given")
    engine = Engine(spark, Config(index_path=str(tmp_path / "rel")))
    engine.index_directory(corpus)
    judged = read_evaluation(spark, queries_file, corpus)
    queries = {r["query"]: r["query"] for r in judged.collect()}
    for ranker in ("bm25", "tfidf"):
        row = summary(engine.search_many(queries, 10, ranker), judged).first()
        assert (row["queries"], round(row["precision_at_5"], 3), round(row["recall_at_10"], 3), round(row["mrr"], 3)) == (33, 0.248, 0.879, 0.970)


def test_synthetic_corpus_is_reproducible(spark):
    a, b = (synthetic_corpus(spark, 20, 12, 7).collect() for _ in range(2))
    assert a == b and len(a[3]["content"].split("\n")[1].split()) == 12


def test_stream_upserts(spark, tmp_path):
    engine = Engine(spark, Config(index_path=str(tmp_path / "s")), id_type="bigint")
    src = tmp_path / "in"
    schema = "id bigint, text string, at bigint"
    spark.createDataFrame([(1, "alpha beta", 1), (2, "gamma", 1), (2, "delta", 2)], schema).write.mode("append").parquet(str(src))

    def run():
        upsert_stream(engine, spark.readStream.schema(schema).parquet(str(src)), "id", "text", str(tmp_path / "cp"), "at").awaitTermination()

    run()
    assert engine.search("delta").total_candidates == 1 and engine.search("gamma").total_candidates == 0
    spark.createDataFrame([(1, "omega", 3)], schema).write.mode("append").parquet(str(src))
    run()
    assert engine.search("omega").total_candidates == 1 and engine.search("alpha").total_candidates == 0 and engine.stats().documents == 2
