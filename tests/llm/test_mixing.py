import os

import pytest

from termloom.llm.bpe import TOKENIZERS
from termloom.llm.mixing import Share, feasible_total, mix, water_fill

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files here")


def test_water_filling():
    s = {"a": Share(0.5, 100, 2), "b": Share(0.3, 1000, 1), "c": Share(0.2, 1000, 1)}
    assert water_fill(s, 300) == pytest.approx({"a": 150, "b": 90, "c": 60})
    assert water_fill(s, 1000) == pytest.approx({"a": 200, "b": 480, "c": 320})
    assert water_fill(s, 10**6) == pytest.approx({"a": 200, "b": 1000, "c": 1000})
    assert water_fill(s, 0) == {"a": 0, "b": 0, "c": 0} and water_fill({}, 5) == {}
    t = {"x": Share(1.0, 0, 3), "y": Share(0.0, 50, 3), "z": Share(0.1, 50, 0), "w": Share(0.1, 50, 4)}
    assert water_fill(t, 120) == pytest.approx({"x": 0, "y": 0, "z": 0, "w": 120})
    assert feasible_total(s) == pytest.approx(400) and feasible_total({}) == 0.0


DOCS = "doc_id bigint, text string, source string, rest string, bin int, h int"
WEIGHTS = "source string, target_share double, max_repeats int, n_tokens int"


def run(spark, docs, weights, **kw):
    mixed, report = mix(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS), spark.createDataFrame([(*w, 3) for w in weights], WEIGHTS), **kw)
    return {r["doc_id"]: (r["source"], r["n_tokens"], r["repeats"]) for r in mixed.collect()}, {r["source"]: r for r in report.collect()}


@needs_vocabulary
def test_shares_are_reached(spark):
    docs = [(i, "word " * (5 + i % 7), "big") for i in range(600)] + [(1000 + i, "tiny thing here", "small") for i in range(20)]
    docs += [(2000, None, "big"), (2001, "", "big"), (2002, "free", None), (2003, "free", "unweighted")]
    weights = [("big", 0.5, 3), ("small", 0.3, 4), ("absent", 0.2, 9), (None, 0.5, 1), ("big", 0.5, 3)]
    mixed, report = run(spark, docs, weights, total_tokens=1000)
    assert set(report) == {"big", "small", "absent"} and not {2000, 2001, 2002, 2003} & set(mixed)
    small = report["small"]
    assert small["planned_tokens"] == small["available_tokens"] * 4 == small["reached_tokens"] and {v[2] for v in mixed.values() if v[0] == "small"} == {4}
    big = report["big"]
    assert abs(big["reached_tokens"] - big["planned_tokens"]) <= 12 and max(v[2] for v in mixed.values() if v[0] == "big") <= 3
    assert big["reached_share"] + small["reached_share"] == pytest.approx(1) and report["absent"]["reached_tokens"] == 0
    assert run(spark, docs, weights, total_tokens=1000)[0] == mixed != run(spark, docs, weights, total_tokens=1000, seed=7)[0]


@needs_vocabulary
def test_whole_and_partial_repetitions(spark):
    docs = [(i, "one two three", "s") for i in range(400)]
    mixed, report = run(spark, docs, [("s", 1.0, 5)], total_tokens=400 * 3 * 2.5)
    counts = [v[2] for v in mixed.values()]
    assert set(counts) == {2, 3} and abs(counts.count(3) - 200) <= 1 and report["s"]["reached_share"] == 1.0


@needs_vocabulary
def test_repeated_rows_count_once(spark):
    docs = [(1, "one two three", "s")] * 500 + [(i, "one two three", "s") for i in range(2, 12)] + [(None, "lost", "s")]
    mixed, report = run(spark, docs, [("s", 1.0, 2)])
    assert {k: v[2] for k, v in mixed.items()} == {i: 1 for i in range(1, 12)} and report["s"]["available_tokens"] == 33


@needs_vocabulary
def test_empty(spark):
    assert run(spark, [], [])[0] == {}
    mixed, report = run(spark, [], [("a", 1.0, 2)])
    assert mixed == {} and report["a"]["reached_share"] == 0.0
    assert run(spark, [(1, "x", "a")], [])[1] == {}
    assert run(spark, [(1, "x", "a")], [("a", None, None)])[0] == {}


@needs_vocabulary
def test_a_document_in_two_sources_is_drawn_from_one(spark):
    mixed, report = run(spark, [(1, "one two", "s"), (1, "one two three", "t"), (1, "one", None), (2, "one", "t")], [("s", 0.5, 1), ("t", 0.5, 1)])
    assert mixed == {1: ("s", 2, 1), 2: ("t", 1, 1)} and report["t"]["available_tokens"] == 1
