import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions.analyze import py_lower, py_tokens
from termloom.llm.neardup import bands_for, near_duplicate_links, near_duplicate_pairs, shingle_classes, signatures, similar_classes, split_words
from termloom.llm.queries import p3_links
from termloom.runtime import table

SCHEMA = "id string, content string, class_id int, shingles string, n int"


def sets(text, words):
    t = [py_lower(x) for x in py_tokens(text or "")]
    return {tuple(t[i : i + words]) for i in range(len(t) - words + 1)}


def brute(rows, words, threshold):
    s = {i: sets(c, words) for i, c in rows if i is not None and sets(c, words)}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def corpus(seed, families=12, size=6, length=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(families):
        base = rnd.choices(words, k=length)
        for k in range(size):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((f"f{f:02d}-{k}", " ".join(t).title() if k % 2 else " ".join(t)))
    return rows


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.6), (5, 0.8)])
def test_pairs_match_brute_force(spark, words, threshold):
    rows = corpus(words) + [("null", None), ("empty", ""), ("short", "one two"), (None, "w1 w2 w3 w4 w5 w6"), ("copy1", "a b c d e f"), ("copy2", "A, b! C d e f"), ("copy3", "a b c d e f")]
    got = {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(frame(spark, rows), "id", "content", words, threshold).collect()}
    want = brute(rows, words, threshold)
    assert got == want and ("copy1", "copy2") in want and len(want) > 20


def test_links(spark):
    rows = [("a", "a b c d e f g h"), ("b", "a b c d e f g h"), ("c", "a b c d e f g x"), ("d", "q r s t"), ("e", None)]
    got = {r["id"]: (r["copies"], r["links"]) for r in near_duplicate_links(frame(spark, rows), "id", "content", 3, 0.6).collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 1), "d": (1, 0)}
    ids = {r["id"]: r["class_id"] for r in near_duplicate_links(frame(spark, rows), "id", "content", 3, 0.6).collect()}
    assert ids["a"] == ids["b"] != ids["c"]


def test_links_of_every_record(spark, sf):
    ja = "小さな通信路を調べる前に、通信路を確かめる必要がある。キャッシュは秒後に文書を削除する。"
    rows = [("j1", ja), ("j2", ja.replace("、", "，")), ("j3", ja.replace("削除", "追加")), ("s1", "One two"), ("s2", "one, two"), ("s3", "one two three four five"), ("k", "東京")]
    rows += [("n", None), ("e", ""), ("b", " \u00a0\n\u3000"), ("p", "...")]
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in near_duplicate_links(frame(spark, rows), "id", "content", 5, 0.7, every=True).collect()}
    assert {k: v[1:] for k, v in got.items()} == {
        "j1": (2, 1), "j2": (2, 1), "j3": (1, 1), "s1": (2, 0), "s2": (2, 0), "s3": (1, 0), "k": (1, 0), "n": (4, 0), "e": (4, 0), "b": (4, 0), "p": (4, 0)
    }
    assert got["s1"][0] == got["s2"][0] and len({got[k][0] for k in "neb"}) == 1 and len({v[0] for v in got.values()}) == 6
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(p3_links(spark, sf).select(F.col("id").alias("doc_id"))) == ids(table(spark, sf, "documents").select("doc_id"))


def test_empty_long_and_repeated(spark):
    assert near_duplicate_pairs(frame(spark, []), "id", "content").count() == 0
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [("l1", long), ("l2", long + " y"), ("l1", long)]
    assert [tuple(r)[:2] for r in near_duplicate_pairs(frame(spark, rows), "id", "content").collect()] == [("l1", "l2")]


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(1, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rnd.integers(1, 2**63, 100, dtype=np.uint64)])
    sig = signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 200 / 400) < 0.04
    w = np.concatenate([np.where(np.arange(300) < 200, 5.0, 1.0)] * 2)
    # equal weights on both sides: sum over the shared elements of 1 / sum of the greater ratios
    both = signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 4096, w)
    want = 1000 / (1000 + 200)
    assert abs((both[0] == both[1]).mean() - want) < 0.04
    alone = signatures(a, np.zeros(300, dtype=int), 1, 4096)
    assert (alone[0] == sig[0]).all() and (signatures(a[:0], np.zeros(0, dtype=int), 1, 8) == 0).all()


def test_bands_keep_what_is_promised():
    for threshold, rows in ((0.6, 3), (0.6, 4), (0.8, 4), (1.0, 4)):
        bands = bands_for(threshold, rows)
        assert (1 - threshold**rows) ** bands <= 2e-6 and (bands == 1 or (1 - threshold**rows) ** (bands - 1) > 2e-6)


def test_no_side_is_broadcast(spark):
    members, classes = shingle_classes(frame(spark, corpus(3)), "id", "content", 3)
    plan = similar_classes(classes, 0.6, 4)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Cartesian" not in plan
    links = near_duplicate_links(frame(spark, corpus(3)), "id", "content", 3, 0.6)._jdf.queryExecution().toString()
    assert "Broadcast" not in links


def test_words_of_plain_and_unspaced_texts(spark):
    rows = [("Ab, c-D é9", ["ab", "c", "d", "é9"]), (" \u0085", []), (None, []), ("x 東京abc。ｶ", ["x", "東", "京", "abc", "ｶ"]), ("กิa", ["กิ", "a"]), ("  é", [" ", "é"])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(split_words(F.col("text")).alias("w"))
    assert [r["w"] for r in df.collect()] == [w for _, w in rows]
