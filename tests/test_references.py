import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from termloom.functions.ids import fnv1a64
from termloom.operators.references import bloom_filter, filter_words, might_contain, orphan_references, orphan_report, ref_key

T = dt.datetime
EV = "eval_id bigint, query string, relevant array<string>, labeled_at timestamp_ntz, key string, kind string"
CUR = "id string, path string, indexed_at timestamp_ntz, key string"
OLD = "id string, path string, key string"


def found(spark, refs, current, former):
    df = orphan_references(
        spark.createDataFrame([(i, None, r, at, "k", "x") for i, r, at in refs], EV), spark.createDataFrame([(*c, "k") for c in current], CUR), spark.createDataFrame([(*f, "k") for f in former], OLD)
    )
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_kinds_and_forms(spark):
    live, gone = fnv1a64("corpus/a.md"), fnv1a64("corpus/old.md")
    current = [(live, "corpus/a.md", T(2025, 1, 1)), (fnv1a64("corpus/n.md"), "corpus/n.md", T(2025, 6, 1)), ("0" * 16, "corpus/x.md", None)]
    former = [(live, "corpus/a.md"), (gone, "corpus/old.md"), (None, None)]
    at = T(2025, 3, 5)
    refs = [
        (1, ["a.md", "./a.md", "corpus/a.md", "./corpus/a.md", live], at),
        (2, ["old.md", gone, "none.md", "f" * 16, "none.md", "", None], at),
        (3, ["n.md", "x.md"], at),
        (3, ["n.md", "x.md"], at),
        (4, None, at),
        (5, [], at),
        (6, ["n.md", "zz"], None),
        (None, ["zz"], at),
    ]
    assert found(spark, refs, current, former) == sorted(
        [(2, "old.md", "deleted", "2025-03"), (2, gone, "deleted", "2025-03"), (2, "none.md", "missing", "2025-03"), (2, "f" * 16, "missing", "2025-03"), (3, "n.md", "late", "2025-03"), (6, "zz", "missing", None), (None, "zz", "missing", "2025-03")], key=repr
    )


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, ["a"], T(2025, 1, 1))], [], []) == [(1, "a", "missing", "2025-01")]


def test_report(spark):
    df = spark.createDataFrame([(1, "a", "missing", "2025-01"), (2, "b", "missing", "2025-01"), (3, "c", "late", None)], "eval_id int, ref string, kind string, period string")
    assert sorted((tuple(r) for r in orphan_report(df).collect()), key=repr) == sorted([("missing", "2025-01", 2), ("late", None, 1)], key=repr)


def test_filter_never_refuses_a_key(spark):
    keys = [f"key{i}" for i in range(2000)]
    words = filter_words(len(keys))
    bits = bloom_filter(spark.createDataFrame([(k,) for k in keys], "k string"), "k", words)
    assert len(bits.first()["bits"]) == words
    asked = spark.createDataFrame([(k,) for k in keys + [f"other{i}" for i in range(2000)]], "k string")
    got = asked.select("k", might_contain(bits.scalar(), F.col("k"), words).alias("m")).collect()
    assert all(r["m"] for r in got if r["k"].startswith("key"))
    assert sum(r["m"] for r in got if r["k"].startswith("other")) < 200
    assert filter_words(0) == 1 and filter_words(10**12) == 1 << 20


def test_hot_reference_and_long_entries(spark):
    refs = [(i, ["hot.md"] + (["y" * 20000] if i == 0 else []), T(2025, 1, 1)) for i in range(3000)]
    assert len(found(spark, refs, [("1" * 16, "corpus/other.md", T(2024, 1, 1))], [("2" * 16, "corpus/hot.md")])) == 3001


@pytest.mark.parametrize(("ref", "want"), [("ABCDEF0123456789", "abcdef0123456789"), ("x.md", "corpus/x.md"), ("./corpus/x", "corpus/x"), ("././x", "corpus/./x")])
def test_keys(spark, ref, want):
    assert spark.createDataFrame([(ref,)], "r string").select(ref_key(F.col("r"))).first()[0] == want


def test_against_a_plain_walk(spark):
    rnd = random.Random(3)
    paths = [f"corpus/d{i}.md" for i in range(60)]
    current = [(fnv1a64(p), p, T(2025, rnd.randint(1, 12), 1)) for p in paths[:30]]
    former = [(fnv1a64(p), p) for p in paths[15:45]]
    refs = [(i, [rnd.choice([p, p[7:], "./" + p[7:], fnv1a64(p)]) for p in rnd.choices(paths, k=4)], T(2025, rnd.randint(1, 12), 2)) for i in range(100)]
    now = {k: at for i, p, at in current for k in (i, p)}
    then = {k for i, p in former for k in (i, p)}
    want = set()
    for i, entries, at in refs:
        for e in entries:
            key = e if len(e) == 16 and "/" not in e and "." not in e else "corpus/" + e.removeprefix("./").removeprefix("corpus/")
            kind = ("late" if now[key] > at else None) if key in now else "deleted" if key in then else "missing"
            if kind:
                want.add((i, e, kind, f"{at:%Y-%m}"))
    assert set(found(spark, refs, current, former)) == want
