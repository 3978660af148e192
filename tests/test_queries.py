import importlib
import sys

import pytest

import __spark_entry__ as entry
from termloom import catalog, problems, surface
from tests.util import assert_same

CORE = catalog.QUERIES | surface.QUERIES | problems.QUERIES
CORE_SQL = catalog.SQL | surface.SQL | problems.SQL


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_its_sql(spark, sf, name):
    if name not in CORE_SQL:
        assert CORE[name](spark, sf).count() >= 0
        return
    assert_same(spark, name, CORE[name], CORE_SQL[name], sf)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("termloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "termloom.llm", None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(CORE)
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["term_match", "bool_and", "bool_nested", "bm25_term_topk", "bm25_or_topk", "tfidf_or_topk", "search_many"])
def test_searches_read_a_pruned_snapshot(spark, sf, name):
    """Terms are pushed to the scan of the postings, which reads positions for phrases only; no query joins the documents for lengths."""
    df = CORE[name](spark, sf)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "/postings]" in x]
    assert scans and all("EqualTo(term" in x or "In(term" in x for x in scans) and "/docs]" not in plan
    if name != "search_many":  # whose terms are a table, and which holds a phrase
        assert "ExistingRDD" not in plan and not any("positions" in x for x in scans)


def test_one_scalar_holds_all_weights(spark, sf):
    """Frequencies of all terms, number of documents and average length: two small reads a query, however many its words."""
    plan = spark._jvm.PythonSQLUtils.explainString(CORE["bm25_or_topk"](spark, sf)._jdf.queryExecution(), "formatted")
    assert plan.count("Scan parquet ") == 2 * 3  # tree and details: postings, terms, collection
