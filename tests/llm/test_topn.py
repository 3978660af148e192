import math
import random

import pytest

from termloom.llm.topn import group_thresholds, score_bin, top_n
from pyspark.sql import functions as F

SCHEMA = "query string, ranker string, document_id string, score double, _extra int, rank_no int"


def brute(rows, n):
    best = {}
    for q, r, d, s in rows:
        if s is not None and not math.isnan(s) and d is not None:
            s = s + 0.0 if s else 0.0
            g = best.setdefault((q, r), {})
            g[d] = max(g.get(d, s), s)
    return {(q, r, i, d) for (q, r), g in best.items() for i, (d, _) in enumerate(sorted(g.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return {(r["query"], r["ranker"], r["rank_no"], r["document_id"]) for r in top_n(df, ["query", "ranker"], "document_id", "score", n, **kw).collect()}


@pytest.mark.parametrize(("seed", "heavy", "n"), [(0, 2000, 5), (1, 10, 5), (2, 1, 1), (3, 1, 12), (4, 10, 100), (5, 10, 0)])
def test_matches_a_plain_ranking(spark, seed, heavy, n):
    rnd = random.Random(seed)
    scores = [None, float("nan"), 0.0, -0.0, 1.5, 2.25, -3.0, float("inf"), float("-inf"), 1e-300, 1e300]
    rows = [(rnd.choice(["hot", "hot", "hot", f"q{rnd.randint(0, 20)}", None]), rnd.choice(["a", "b", None]), rnd.choice([f"d{rnd.randint(0, 150)}", None, ""]), rnd.choice([*scores, round(rnd.gauss(0, 5), 1)])) for _ in range(3000)]
    assert run(spark, rows, n, heavy_rows=heavy) == brute(rows, n)


def test_many_copies_of_one_item_set_no_floor_too_high(spark):
    rows = [("q", "a", "best", 9.0)] * 500 + [("q", "a", f"d{i}", float(i) / 100) for i in range(10)]
    assert run(spark, rows, 5, heavy_rows=10) == brute(rows, 5)


def test_equal_scores_and_empty(spark):
    rows = [("q", "a", f"d{i:05d}", 1.0) for i in range(5000)]
    assert run(spark, rows, 3, heavy_rows=10) == {("q", "a", i, f"d{i - 1:05d}") for i in (1, 2, 3)}
    assert run(spark, [], 5) == set()
    assert run(spark, [("q", "a", "d" * 10000, 1.0)], 5) == {("q", "a", 1, "d" * 10000)}


def test_bins_never_fall(spark):
    values = sorted([0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), *[s * 2.0**e * m for s in (1, -1) for e in range(-60, 60, 3) for m in (1.0, 1.01, 1.99)]])
    bins = [r["b"] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(score_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("n", [64, 65, 300])
def test_floors_for_any_n(spark, n):
    """A large group gets a floor that drops rows, and keeps its n best, however large n is."""
    rows = spark.range(20_000).selectExpr("'g' AS q", "concat('i', id % 9000) AS item", "cast(pmod(xxhash64(id % 9000), 1000) AS double) + 1 AS score")
    heavy = rows.select("q").distinct()
    scored = rows.selectExpr("q", "item AS _item", "score AS _score").withColumn("_bin", score_bin(F.col("_score")))
    floor = group_thresholds(scored, ["q"], n, heavy).first()["floor_bin"]
    above = scored.where(F.col("_bin") >= floor).select("_item").distinct().count()
    assert n <= above < 9000
    best = [r["item"] for r in top_n(rows, ["q"], "item", "score", n).orderBy("rank_no").collect()]
    want = [r["item"] for r in rows.groupBy("item").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "item").limit(n).collect()]
    assert best == want
