import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom import surface
from termloom.config import Config
from termloom.engine import Engine
from termloom.functions.ids import fnv1a64
from termloom.sources import directory
from termloom.sources.directory import scan_directory, write_files


def test_a_listing_goes_on_where_a_task_stopped(spark, tmp_path, monkeypatch):
    """Any shape of tree comes out whole, whatever part of it a task takes; hidden and other files stay out, links are followed."""
    root, want = tmp_path / "corpus", set()
    for i in range(60):
        at = root / "/".join(f"d{j}" for j in range(i % 7)) / str(i)
        at.mkdir(parents=True)
        for j in range(i % 4):
            (at / f"é {j}+%41.{('md', 'TXT')[j % 2]}").write_text("" if j else "word")
            want.add(str(at / f"é {j}+%41.{('md', 'TXT')[j % 2]}"))
    for name in (".x.md", "_x.md", "x.html", "x.md.txt._COPYING_", "_k=1.md", "_metadata.txt"):
        (root / name).write_text("x")
    want |= {str(root / n) for n in ("_k=1.md", "_metadata.txt")}
    (root / "gone.md").symlink_to(tmp_path / "nowhere")
    (tmp_path / "out.md").write_text("x")
    (root / "link.md").symlink_to(tmp_path / "out.md")
    want.add(str(root / "link.md"))
    bad = os.fsencode(root) + b"/\xff.md"
    Path(os.fsdecode(bad)).write_text("word")
    monkeypatch.setattr(directory, "WALK_ENTRIES", 30)
    for at in (str(root), f"file://{root}/"):
        rows = scan_directory(spark, at).collect()
        shown = at.rstrip("/")
        assert sorted(r["path"] for r in rows) == sorted([shown + x.removeprefix(str(root)) for x in want] + [f"{shown}/�.md"])
        assert all(r["error"] is None for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
        by = {r["path"]: r for r in rows}
        for x in want:
            r = by[shown + x.removeprefix(str(root))]
            assert r["doc_id"] == fnv1a64(r["path"]) and r["modified_time"] == int(os.stat(x).st_mtime) and bytes(r["raw"]) == Path(x).read_bytes()
        assert sorted(scan_directory(spark, at, False).collect()) == sorted((r["doc_id"], r["path"], r["modified_time"]) for r in rows)


def test_files_are_written_by_tasks(spark, tmp_path):
    """A file for each row, in folders of a bounded size, without companions."""
    root = str(tmp_path / "files")
    rows = spark.range(2500).select(F.concat(F.lit("n"), (F.col("id") % 2000).cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("word "), "id").cast("binary").alias("content"))
    write_files(rows.coalesce(1), root)
    files = [Path(at, f) for at, _, fs in os.walk(root) for f in fs]
    assert sorted(f.read_text() for f in files) == sorted(f"word {i}" for i in range(2500))
    assert len({f.parent for f in files}) == 3 and all(f.suffix == ".txt" for f in files)
    os.mkfifo(tmp_path / "files" / "pipe.md")  # to open it would never end
    engine = Engine(spark, Config(index_path=str(tmp_path / "index")))
    for expected in ((2500, 2500, 0, 0), (2500, 0, 2500, 0)):
        r = engine.index_directory(root)
        assert (r.found, r.added, r.unchanged, r.errors) == expected
    assert engine.stats().documents == 2500


@pytest.mark.parametrize("name", ["directory_scan", "directory_reindex"])
def test_rows_of_the_same_id_are_files_of_their_own(spark, tmp_path, name):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (None, "x"), (-2, None), (3, "the\nlock\r\nfile")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in surface.QUERIES[name](spark, str(tmp_path)).collect())
    if name == "directory_scan":
        assert got == [(-2, 0), (1, 1), (1, 2), (3, 2)]
    else:
        assert got == [("first", 4, 4, 0, 0), ("second", 4, 0, 4, 0)]


def test_each_run_opens_what_it_needs_once(spark, tmp_path, monkeypatch):
    """A full run makes documents, postings, errors and counts of one read of each file; a later one reads new and changed files only."""
    root, log = tmp_path / "corpus", str(tmp_path / "log")

    def scan(spark, root, with_content=True):
        @F.udf("binary")
        def noted(raw):
            with open(log, "ab") as f:
                f.write(b".")
            return bytes(raw)

        rows = scan_directory(spark, root, with_content)
        return rows.withColumn("raw", noted("raw")) if with_content else rows

    monkeypatch.setattr("termloom.engine.scan_directory", scan)
    root.mkdir()
    for i in range(20):
        (root / f"{i}.md").write_text(f"word{i}")
    engine = Engine(spark, Config(index_path=str(tmp_path / "index")))
    for added, updated, opened in ((20, 0, 20), (0, 0, 20), (1, 1, 22)):
        if updated:
            (root / "new.md").write_text("new")
            os.utime(root / "3.md", (1, 1))
        r = engine.index_directory(str(root))
        assert (r.added, r.updated, r.errors, os.path.getsize(log)) == (added, updated, 0, opened)
    assert engine.stats().documents == 21
