import math
import random

import pytest

from termloom.llm.terms import clean_postings, distinctive_terms, marked_frequencies, saturated_tf, term_weights
from pyspark.sql import functions as F

P = "term string, doc_id string, term_frequency int, positions array<int>, indexed_at bigint, df int, n string, weight double"
S = "document_count bigint, total_tokens bigint, n string"


def postings(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 0.5) for r in rows], P)


def stats(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], S)


ROWS = [
    ("a", "d1", 5, [0, 1, 2, 3, 4], 2), ("a", "d1", 1, [0], 1), ("a", "d1", 5, [0, 1, 2, 3, 4], 2),
    ("b", "d1", None, [7, 8], 1), ("b", "d2", None, None, 1), ("b", "d3", 0, [], None),
    ("", "d1", 3, [1], 1), (None, "d1", 3, [1], 1), ("c", None, 3, [1], 1),
    ("t", "d4", 1, None, 5), ("t", "d4", 2, None, 5), ("t", "d4", None, [1, 2, 3], 4),
]


def test_clean_postings(spark):
    got = {(r["term"], r["doc_id"]): r["tf"] for r in clean_postings(postings(spark, ROWS)).collect()}
    assert got == {("a", "d1"): 5, ("b", "d1"): 2, ("b", "d2"): None, ("b", "d3"): 0, ("t", "d4"): 2}


def test_marks(spark):
    got = {r["term"]: (r["occurrences"], r["df"], r["mark"]) for r in marked_frequencies(postings(spark, ROWS), stats(spark, (3, 10), (1, 2))).collect()}
    assert got == {"a": (5, 1, "rare"), "b": (2, 3, "common"), "t": (2, 1, "rare")}
    assert marked_frequencies(postings(spark, []), stats(spark)).count() == 0


def brute(rows, n, factor=2.0):
    best = {}
    for term, doc, tf, pos, at in rows:
        if term and doc is not None:
            f = tf if tf is not None else len(pos) if pos is not None else None
            key = (at is not None, at or 0, f is not None, f or 0)
            if (term, doc) not in best or key > best[term, doc][0]:
                best[term, doc] = (key, f)
    df = {}
    for term, _ in best:
        df[term] = df.get(term, 0) + 1
    return {(d, t) for (t, d), (_, f) in best.items() if f and f > 0 and n > 0 and (1 + math.log(f)) * (math.log(n / df[t]) + 1) >= factor * (1 + math.log(n)) * (1 - 1e-12)}


@pytest.mark.parametrize("seed", range(3))
def test_distinctive_terms_match_the_rule(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", "c", "d", f"r{rnd.randint(0, 40)}", "", None]), f"d{rnd.randint(0, 60)}", rnd.choice([None, 0, 1, 2, 4, 9, 40]), rnd.choice([None, [1, 2, 3]]), rnd.randint(1, 5)) for _ in range(900)]
    got = {(r["doc_id"], r["term"]) for r in distinctive_terms(postings(spark, rows), stats(spark, (61, 3000))).collect()}
    assert got == brute(rows, 61) and got
    for factor in (1.0, 3.0):
        got = {(r["doc_id"], r["term"]) for r in distinctive_terms(postings(spark, rows), stats(spark, (61, 3000)), factor).collect()}
        assert got == brute(rows, 61, factor)


def test_edges(spark):
    assert distinctive_terms(postings(spark, ROWS), stats(spark)).count() == 0
    assert term_weights(postings(spark, []), stats(spark, (1, 1))).count() == 0
    w = {(r["term"], r["doc_id"]): r["weight"] for r in term_weights(postings(spark, ROWS), stats(spark, (4, 12))).collect()}
    assert w["b", "d2"] is None and w["b", "d3"] == 0 and w["a", "d1"] > w["b", "d1"] > 0


def test_saturation_rises_and_levels_off(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 2, 10, 1000)], "t int").select(saturated_tf(F.col("t"), F.lit(10), F.lit(10.0)).alias("s"))
    s = [r["s"] for r in df.collect()]
    assert s == sorted(s) and s[0] == 0 and s[1] == pytest.approx(1.0) and s[-1] < 2.2
