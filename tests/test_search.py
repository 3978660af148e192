import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import index as I
from termloom.plans.compile import leaf_counts, matches, matches_by_sets, phrase_starts, scored, search_many, top_k, _Slots
from termloom.plans.query import And, Not, Or, Phrase, Term, parse_query
from termloom.sources.tables import corpus_from_table

DOCS = [
    (1, "# Introduction to Machine Learning\n\nMachine learning builds models from data. It is a field of study."),
    (2, "# Databases\n\nA database stores rows. The database engine PostgreSQL is common."),
    (3, "Deep learning is a kind of machine learning with many layers"),
]


def make(spark, rows):
    return I.build_index(corpus_from_table(spark.createDataFrame(rows, "id bigint, text string"), "id", "text"))


@pytest.fixture(scope="module")
def index(spark):
    return make(spark, DOCS)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("database", [2]),
        ("machine postgresql", []),
        ("machine OR database", [1, 2, 3]),
        ("learning NOT database", [1, 3]),
        ('"machine learning"', [1, 3]),
        ('"learning database"', []),
        ("machine AND the", []),
        ("machine OR the", [1, 3]),
        ("NOT the", [1, 2, 3]),
        ("NOT NOT database", [2]),
        ('"builds models"', [1]),
        ("database OR NOT machine", [2]),
        ("nothing", []),
        ('"nothing here"', []),
    ],
)
def test_boolean(index, query, want):
    tree = parse_query(query)
    assert ids(matches(index, tree)) == want == ids(matches_by_sets(index, tree))


def test_build(spark):
    ix = make(spark, [(1, "machine learning machine"), (2, "machine"), (3, "database"), (4, None), (5, "the of"), (None, "lost")])
    p = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in ix.postings.collect()}
    assert p[("machine", 1)] == (2, [0, 2]) and p[("learn", 1)] == (1, [1]) and len(p) == 4
    assert {r["term"]: (r["df"], r["cf"]) for r in ix.terms.collect()} == {"machine": (2, 3), "learn": (1, 1), "database": (1, 1)}
    assert tuple(ix.stats.first()) == (5, 5, 1.0)
    assert {r["doc_id"]: r["token_count"] for r in ix.docs.collect()} == {1: 3, 2: 1, 3: 1, 4: 0, 5: 0}
    gone = I.delete(ix, spark.createDataFrame([(1,), (99,)], "doc_id bigint"))
    assert {r["term"]: r["df"] for r in gone.terms.collect()} == {"machine": 1, "database": 1} and gone.stats.first()["n_docs"] == 4
    new = I.upsert(ix, corpus_from_table(spark.createDataFrame([(2, "engine"), (7, "engine")], "id bigint, text string"), "id", "text"))
    assert {r["term"]: r["df"] for r in new.terms.collect()} == {"machine": 1, "learn": 1, "database": 1, "engine": 2}


def test_empty_index(spark):
    ix = make(spark, [])
    assert tuple(ix.stats.first()) == (0, 0, 0.0)
    for q in ("a1", "NOT a1", '"a1 b1"', "a1 OR b1"):
        assert scored(ix, parse_query(q)).count() == 0


def test_scores_rank_and_ties(index, spark):
    one = {r["doc_id"]: r["score"] for r in scored(index, parse_query("machine")).collect()}
    two = {r["doc_id"]: r["score"] for r in scored(index, parse_query("machine machine")).collect()}
    assert two[1] == pytest.approx(2 * one[1])
    assert {r["score"] for r in scored(index, parse_query("NOT database")).collect()} == {0.0}
    tied = make(spark, [(5, "a1 b1"), (4, "b1 a1"), (9, "c1")])
    assert [(r["rank"], r["doc_id"]) for r in top_k(scored(tied, parse_query("a1")), 1).collect()] == [(1, 4)]
    both = {r["doc_id"] for r in scored(index, parse_query("learning"), "tf-idf").collect()}
    assert both == {r["doc_id"] for r in scored(index, parse_query("learning"), "whatever").collect()}


def test_not_parity_scores_what_is_under_two_nots(index):
    a = {r["doc_id"]: r["score"] for r in scored(index, parse_query("machine NOT (rows AND NOT learning)")).collect()}
    b = {r["doc_id"]: r["score"] for r in scored(index, parse_query("machine")).collect()}
    assert a.keys() == b.keys() and all(a[k] > b[k] for k in a)


def test_phrase_occurrences(index):
    assert {r["doc_id"]: r["starts"] for r in phrase_starts(index, Phrase(("machine", "learn"))).collect()} == {1: [1, 3], 3: [3]}


def test_many_queries_at_once(index):
    queries = {"a": "machine", "b": '"machine learning" OR database', "c": "NOT database", "d": "the", "e": "learning NOT database"}
    trees = {k: parse_query(q) for k, q in queries.items()}
    for ranker in ("bm25", "tfidf"):
        got = {(r["query"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in search_many(index, trees, 10, ranker).collect()}
        want = {(k, r["rank"]): (r["doc_id"], round(r["score"], 9)) for k, t in trees.items() for r in top_k(scored(index, t, ranker), 10).collect()}
        assert got == want


def test_random_trees_agree_in_both_forms(spark):
    rnd = random.Random(7)
    words = ["w1", "w2", "w3", "w4"]
    ix = make(spark, [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 6)))) for i in range(40)])
    ix = I.Index(ix.docs.cache(), ix.postings.cache(), ix.terms, ix.stats)

    def tree(depth):
        kind = rnd.choice(["t", "p"] if depth == 0 else ["t", "p", "and", "or", "not"])
        if kind == "t":
            return Term(rnd.choice([*words, "", "w9"]))
        if kind == "p":
            return Phrase(tuple(rnd.choices(words, k=rnd.randrange(1, 4))))
        if kind == "not":
            return Not(tree(depth - 1))
        return (And if kind == "and" else Or)(tree(depth - 1), tree(depth - 1))

    for _ in range(12):
        t = tree(3)
        assert ids(matches(ix, t)) == ids(matches_by_sets(ix, t)), t


def test_plan_pushes_terms_and_prunes_positions(spark, index, tmp_path):
    index.postings.write.parquet(str(tmp_path / "p"))
    ix = I.Index(index.docs, spark.read.parquet(str(tmp_path / "p")), index.terms, index.stats)
    tree = parse_query("machine database")
    plan = leaf_counts(ix, _Slots.of(tree))._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "positions" not in plan


def test_diff_and_apply(spark):
    schema = "doc_id string, path string, title string, content string, modified_time bigint, error string"
    old = spark.createDataFrame([("a", "a.md", "a", "alpha one", 1, None), ("b", "b.md", "b", "beta", 1, None), ("c", "c.md", "c", "gamma", 1, None), ("e", "e.md", "e", "kept", 1, None)], schema)
    new = spark.createDataFrame([("a", "a.md", "a", "alpha one", 1, None), ("b", "b.md", "b", "delta", 2, None), ("d", "d.md", "d", "alpha", 1, None), ("e", "e.md", "e", None, 2, "broken")], schema)
    ix = I.build_index(old)
    diff = I.index_diff(new, ix.docs)
    assert {r["doc_id"]: r["change"] for r in diff.collect()} == {"a": "unchanged", "b": "updated", "c": "deleted", "d": "added", "e": "error"}
    after = I.apply_changes(ix, diff, new)
    assert {r["term"]: r["df"] for r in after.terms.collect()} == {"alpha": 2, "one": 1, "delta": 1, "kept": 1}
    assert after.stats.select("n_docs").first()[0] == 4


def test_size_estimate(spark):
    row = I.size_estimate(make(spark, [(1, "ab cd ab")])).first()
    assert (row["documents"], row["terms"], row["total_tokens"], row["average_document_length"]) == (1, 2, 3, 3.0)
    assert row["index_size_bytes"] == (1 + 1 + 8 + 24) + (2 + 8 + 8 + 8) + (2 + 8 + 8 + 4)


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "x1 y1", "z", 3)], "id bigint, text string, term string, pos int")
    assert corpus_from_table(df, "id", "text").columns == ["doc_id", "path", "title", "content", "modified_time", "error"]
    assert I.build_index(corpus_from_table(df, "id", "text")).postings.where(F.col("term") == "x1").count() == 1


def test_postings_match_those_of_the_shuffle(spark):
    rows = [(1, "The running of Databases, databases & the caf\u00e9"), (2, None), (3, ""), (4, "seeing " * 3000 + "x"), (4, "seeing again"), (5, "\u65e5\u672c\u8a9e the \U0001f600x")]
    c = corpus_from_table(spark.createDataFrame(rows[:4] + rows[5:], "id bigint, text string"), "id", "text")
    key = lambda df: sorted((r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in df.collect())
    assert key(I.document_postings(c)) == key(I.postings_by_shuffle(c))
    assert key(I.document_postings(c, ["running"])) == key(I.postings_by_shuffle(c, ["running"]))
    assert I.document_postings(c.limit(0)).count() == 0
