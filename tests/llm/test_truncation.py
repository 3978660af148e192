import math
import random

import numpy as np
import pandas as pd
import pytest

from termloom.llm.truncation import beginnings, ending, endings, fit_censored, fit_evidence, limit_posteriors, truncation, truncation_rates

KINDS = {
    "sentence": ["It is done.", "Was it? ", "Done.”", "これは本です。", "Done. :)", "Done. ✓", "Done. (see above)", "<p>Done.</p> &nbsp;", "- A list item that is a sentence.", "Done.)"],
    "marked": ["It is do…", "It is do …", "It is do [...]", "It is do… (cut)", "It is do … [read on]", "It is d\ufffd"],
    "left_out": ["Done! …", "Done. … (cut)"],
    "fence": ["a\n```\nx = 1", "```\nx\n```\n```\ny"],
    "code": ["a.\n```\nx = 1\n```"],
    "dots": ["It went on and on..."],
    "list": ["a:\n\n- one thing", "1. one thing"],
    "row": ["| a | 1 |\n| b | 22 |"],
    "address": ["See also: docs/a/b.md", "https://x.example/a/b"],
    "signature": ["Done.\n-- The team, winter notes"],
    "tags": ["Done.\n\nTags: a, b, c"],
    "heading": ["Done.\n\n## Next"],
    "open": ["It is do", "Done. It is,", "It is 4", "古い鍵を調べる前に", "It is (in fact) so", "It is do [more]", "To the viewport, <|endoftext|"],
    "tag": ["Done. It is <b", "It is &nbs", "It is <a href='" + "x" * 900],
    "bracket": [],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_endings(kind, text):
    assert ending(text)[0] == kind


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(0)
    x = rng.normal(6.0, 0.6, 20000)
    limit = math.log(500)
    mean, dev = fit_censored(x[x < limit], np.ones((x < limit).sum()), np.array([limit]), np.array([float((x >= limit).sum())]))
    assert abs(mean - 6.0) < 0.05 and abs(dev - 0.6) < 0.05


SENTENCES = ["The {} index of the {} reader sends {} rows.", "A {} lock keeps the {} page for {} seconds.", "Nobody counts the {} cursor of a {} table {} times."]
WORDS = ["warm", "cold", "secondary", "primary", "narrow", "database", "temporary"]
SCHEMA = "doc_id bigint, text string, source string, declared_bytes bigint, kind string, at int"


def make(seed=1, n=600):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(rnd.choice(SENTENCES).format(rnd.choice(WORDS), rnd.choice(WORDS), rnd.randint(2, 900)) for _ in range(rnd.randint(2, 30)))
        kind = rnd.random()
        if kind < 0.2:
            text += "\n\n- " + rnd.choice(WORDS) + " lock\n- " + rnd.choice(WORDS) + " " + rnd.choice(["table", "reader", "database"])
        source, declared = rnd.choice(["s1", "s2", None]), rnd.choice([None, len(text.encode())])
        if source == "s1" and len(text) > 400:
            text = text[:400]
            cut.add(i)  # whatever it ends in
        elif rnd.random() < 0.05:
            text = text[: rnd.randrange(20, len(text))]
        stripped = text.rstrip()
        if stripped[-1].isalnum() and "\n- " not in text or stripped[-1] in ",":
            cut.add(i)
        rows.append((i, text, source, declared))
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = make()
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    got = {r["doc_id"] for r in truncation(df).where("is_cut").collect()}
    assert len(cut) > 50
    assert len(got & cut) >= 0.98 * len(cut) and len(got - cut) <= 0.05 * len(got)
    limits = {(r["source"], r["unit"], r["at"]) for r in limit_posteriors(endings(df)).where("censored > 0.8").collect()}
    assert ("s1", "chars", 400) in limits and not [x for x in limits if x[0] == "s2"]
    rates = {r["source"]: r["rate"] for r in truncation_rates(truncation(df)).collect()}
    assert set(rates) == {"s1", "s2", None} and rates["s1"] > 3 * rates["s2"]


def test_list_items_cut_inside_a_word(spark):
    rows = [(i, f"All is well.\n\n- {WORDS[i % 7]} lock\n- {WORDS[i % 5]} database", "s", None) for i in range(120)]
    rows.append((999, "All is well.\n\n- warm lock\n- cold databa", "s", None))
    rows.append((998, "All is well.\n\n- warm lock\n- cold", "s", None))
    got = {r["doc_id"] for r in truncation(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)).where("is_cut").collect()}
    assert got >= {999} and got <= {998, 999}


def test_edges(spark):
    rows = [(1, None, "s", 5), (2, "", "s", 0), (3, " \n\t", None, None), (4, "Fine.", None, None), (4, "Fine.", None, None), (5, "word " * 40000 + "cu", "s", None), (None, "cut he", "s", 900)]
    got = sorted(((r["doc_id"], r["is_cut"]) for r in truncation(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)).collect()), key=repr)
    assert got == sorted([(4, False), (4, False), (5, True), (None, True)], key=repr)
    assert truncation(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [2, 60, 100, 5000])
def test_asides_of_any_length(n):
    aside = "(" + "as it was said " * n + "then)"
    assert ending("It is done. " + aside)[0] == "sentence" and ending(aside)[0] == "bracket"
    assert ending("It is done and " + aside)[0] == "open" and ending("It is done. " + aside[:-1])[0] == "open"
    assert ending("It is done. :-" + ")" * n)[0] == "sentence"


def cells(rows):
    return pd.DataFrame(rows, columns=["kind", "announced", "censored", "n"])


def test_the_table_decides_what_endings_mean():
    usual = [("sentence", "other", 0.0, 9000), ("open", "other", 0.0, 100), ("open", "more", 0.0, 60), ("open", "other", 0.99, 300), ("sentence", "other", 0.99, 3)]
    by_kind, by_size, elsewhere = fit_evidence(cells(usual))
    at_limit = math.log(0.99 / 0.01)
    assert by_kind["sentence"] + by_size["other"] + at_limit < 0 < by_kind["open"] + by_size["other"] + math.log(elsewhere / (1 - elsewhere))
    # The same endings, of which far more than chance has it stand at a limit: there, and only there, they are cuts.
    by_kind, by_size, elsewhere = fit_evidence(cells([*usual[:4], ("sentence", "other", 0.99, 200)]))
    assert by_kind["sentence"] + by_size["other"] + at_limit > 0 > by_kind["sentence"] + by_size["other"] + math.log(elsewhere / (1 - elsewhere))
    tenfold = fit_evidence(cells([(*r[:3], 10 * r[3]) for r in usual]))[0]
    assert all(abs(v - fit_evidence(cells(usual))[0][k]) < 0.1 for k, v in tenfold.items())


def test_cuts_at_a_limit_that_end_like_sentences(spark):
    """Without the posterior of the length none of them comes out: all other texts of their source, and all their endings, are those of whole texts."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        text = " ".join(rnd.choice(SENTENCES).format(rnd.choice(WORDS), rnd.choice(WORDS), rnd.randint(2, 900)) for _ in range(rnd.randint(2, 40)))
        rows.append((i, text, "s", None))
    planted = []
    for i in range(3000, 3080):
        text = " ".join(rnd.choice(SENTENCES).format(rnd.choice(WORDS), rnd.choice(WORDS), rnd.randint(2, 900)) for _ in range(40))
        planted.append((i, text[:511] + ".", "t", None))
    whole = [(i + 5000, r[1], "t", None) for i, r in enumerate(rows[:300])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows + planted + whole], SCHEMA)
    got = {r["doc_id"] for r in truncation(df).where("is_cut").collect()}
    assert len(got & {r[0] for r in planted}) == 80 and len(got) <= 84


def test_dots_as_a_sign_of_a_limit(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        text = " ".join(rnd.choice(SENTENCES).format(rnd.choice(WORDS), rnd.choice(WORDS), rnd.randint(2, 900)) for _ in range(rnd.randint(3, 30)))
        source = "t" if i % 3 == 0 else "s"
        if source == "t" and len(text) > 400:
            text = text[:397] + "..."
        elif i % 40 == 1:
            text = text[:-1] + "..."
        rows.append((i, text, source, None))
    cut = {r[0] for r in rows if r[2] == "t" and len(r[1]) == 400}
    got = {r["doc_id"] for r in truncation(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)).where("is_cut").collect()}
    assert len(got & cut) >= 0.98 * len(cut) and len(got - cut) <= 2


def test_beginnings():
    a, b = beginnings("abc", "g"), beginnings("abcd", "g")
    assert b[:3] == a and len(set(b) | set(beginnings("abcd", "h"))) == 8 and beginnings("", "g") == []
