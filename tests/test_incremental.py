import random
from collections import Counter

import pytest

from termloom.operators import incremental
from termloom.operators.incremental import ChangeFeed, open_from, replay_changes, state_after

LIST = "run_no int, path string, modified_time bigint, listed_at bigint, turn int, version string"
RUNS = "run_no int, status string, turn int"
META = "path string, modified_time bigint, turn int"


def tables(spark, listed, runs, meta):
    """With columns of clashing names beside the needed ones."""
    return (
        spark.createDataFrame([(*r, 7, "x") for r in listed], LIST),
        spark.createDataFrame([(*r, 7) for r in runs], RUNS),
        spark.createDataFrame([(*r, 7) for r in meta], META),
    )


def brute(listed, runs, meta):
    state, found = dict(meta), set()
    for run in sorted({r for r, s in runs if s == "ok" and r is not None}):
        best = {}
        for r, p, m, at in listed:
            if r == run and p is not None:
                key = (at is not None, at or 0, m is not None, m or 0)
                if p not in best or key > best[p][0]:
                    best[p] = (key, m)
        new = {}
        for p, (_, m) in best.items():
            if m is None:
                if p in state:
                    new[p] = state[p]
            else:
                if p not in state or state[p] != m:
                    found.add((run, p, m))
                new[p] = m
        state = new
    return found, state


def random_log(seed, runs=7, paths=6, rows=150):
    rnd = random.Random(seed)
    log = [(r, rnd.choice(["ok", "ok", "ok", "failed", None])) for r in range(1, runs + 1)]
    listed = [(rnd.randint(1, runs), rnd.choice([f"p{i}" for i in range(paths)]), rnd.choice([None, 0, 1, 2]), rnd.randint(1, 9)) for _ in range(rows // 3)]
    return listed + listed[:5], log, [(f"p{i}", rnd.choice([None, 1, 2])) for i in range(3)]


@pytest.mark.parametrize("seed", range(5))
def test_replay_matches_a_plain_walk(spark, seed):
    listed, runs, meta = random_log(seed)
    a, b, c = tables(spark, listed, runs, meta)
    want, state = brute(listed, runs, meta)
    assert {tuple(r) for r in replay_changes(a, b, c).collect()} == want
    assert {tuple(r) for r in state_after(a, b, c).collect() if r[0] is not None} == set(state.items())


def test_rules(spark):
    listed = [
        (1, "new", 5, 1), (1, "same", 3, 1), (1, "nulltime", 4, 1), (1, "unread", None, 1), (1, None, 9, 1), (None, "norun", 9, 1),
        (2, "new", 5, 1), (2, "same", None, 2), (2, "late", 8, 1), (2, "late", 9, 5), (2, "late", 8, 1),
        (3, "same", 7, 1),
        (4, "same", 3, 1), (4, "new", 5, 1), (4, "unread", 1, None),
    ]
    runs = [(1, "ok"), (2, "ok"), (2, "ok"), (3, "failed"), (4, "ok"), (None, "ok"), (5, None)]
    meta = [("same", 3), ("nulltime", None), (None, 3)]
    got = {tuple(r) for r in replay_changes(*tables(spark, listed, runs, meta)).collect()}
    assert got == {(1, "new", 5), (1, "nulltime", 4), (2, "late", 9), (4, "unread", 1)}


def test_empty_tables(spark):
    assert replay_changes(*tables(spark, [], [], [])).count() == 0
    assert replay_changes(*tables(spark, [(1, "a", 1, 1)], [], [])).count() == 0
    assert replay_changes(*tables(spark, [(1, "a", 1, 1)] * 1000, [(1, "ok")], [])).count() == 1


def test_open_from(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, None), (3, "ok"), (4, None)], "run_no int, status string")
    assert open_from(runs, 0) == 2 and open_from(runs, 2) == 4 and open_from(runs.where("status = 'ok'"), 0) == 4


@pytest.mark.parametrize("seed", range(3))
def test_feed_gives_each_change_once_over_failures(spark, tmp_path, monkeypatch, seed):
    listed, runs, meta = random_log(seed, runs=5)
    want, _ = brute(listed, runs, meta)
    feed = ChangeFeed(spark, str(tmp_path / "feed"))
    a, _, c = tables(spark, listed, runs, meta)
    feed.start(c)
    given = Counter()
    commit = feed._commit
    for upto in range(1, 6):
        log = [(r, s if r < upto or s != "ok" else "ok") for r, s in runs if r <= upto]
        rows = a.where(f"run_no <= {upto}")
        b = spark.createDataFrame(log, "run_no int, status string")
        monkeypatch.setattr(feed, "_commit", lambda p: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            feed.process(rows, b)
        monkeypatch.setattr(feed, "_commit", commit)
        given.update(tuple(r) for r in feed.process(rows, b).collect())
    assert set(given) == want and set(given.values()) <= {1}
    assert feed.process(a, spark.createDataFrame(runs, "run_no int, status string")).count() == 0


def test_feed_rereads_from_the_oldest_open_run(spark, tmp_path):
    schema = "run_no int, path string, modified_time bigint, listed_at bigint"
    runs = lambda *x: spark.createDataFrame(x, "run_no int, status string")
    feed = ChangeFeed(spark, str(tmp_path / "f"), grace_runs=0)
    with pytest.raises(ValueError):
        feed.process(spark.createDataFrame([], schema), runs((1, "ok")))
    feed.start(spark.createDataFrame([("a", 1)], "path string, modified_time bigint"))
    first = [(1, "a", 2, 1), (2, "b", 1, 2), (2, "a", 2, 2)]
    assert {tuple(r)[:2] for r in feed.process(spark.createDataFrame(first, schema), runs((1, "ok"), (2, None))).collect()} == {(1, "a")}
    assert feed._pointer()["low"] == 2
    then = [*first, (2, "c", 1, 9)]
    assert {tuple(r)[:2] for r in feed.process(spark.createDataFrame(then, schema), runs((1, "ok"), (2, "ok"))).collect()} == {(2, "b"), (2, "c")}
    assert incremental.open_from(runs((1, "ok"), (2, "ok")), 1) == 3


def test_feed_takes_rows_of_any_closed_run(spark, tmp_path):
    listings = lambda x: spark.createDataFrame(x, "run_no int, path string, modified_time bigint, listed_at bigint")
    runs = lambda *x: spark.createDataFrame(x, "run_no int, status string")
    feed = ChangeFeed(spark, str(tmp_path / "late"))
    feed.start(spark.createDataFrame([("a", 1)], "path string, modified_time bigint"))
    rows = [(n, "a", n, n) for n in range(1, 6)] + [(2, "c", 1, 2)]
    log = [(1, "ok"), (2, None), (3, "ok"), (4, "ok"), (5, "ok")]
    process = lambda: {tuple(r) for r in feed.process(listings(rows), runs(*log)).collect()}
    log[1] = (2, "failed")
    assert process() == {(n, "a", n) for n in (2, 3, 4, 5)} - {(2, "a", 2)} and feed._pointer()["low"] == 5
    rows += [(1, "b", 7, 99), (3, "b", 7, 99)]
    assert process() == {(1, "b", 7)} and feed._pointer()["low"] == 5
    assert process() == set()
    log[1] = (2, "ok")  # a verdict that is changed late
    assert process() == {(2, "a", 2), (2, "c", 1), (3, "b", 7)}
    assert process() == set()


def test_changes_come_again_until_they_are_acknowledged(spark, tmp_path):
    listings = spark.createDataFrame([(1, "a", 2, 1), (1, "b", 1, 1)], "run_no int, path string, modified_time bigint, listed_at bigint")
    runs = spark.createDataFrame([(1, "ok")], "run_no int, status string")
    ChangeFeed(spark, str(tmp_path / "f")).start(spark.createDataFrame([("a", 1)], "path string, modified_time bigint"))
    for _ in range(2):
        feed = ChangeFeed(spark, str(tmp_path / "f"))  # the caller before died
        assert {tuple(r) for r in feed.fetch(listings, runs).collect()} == {(1, "a", 2), (1, "b", 1)}
    feed.ack()
    assert feed.fetch(listings, runs).count() == 0
    feed.ack(), feed.ack()
    assert ChangeFeed(spark, str(tmp_path / "f")).process(listings, runs).count() == 0


def test_states_in_parts_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ChangeFeed, "MERGE_AT", 3)
    listed, runs, meta = random_log(11, runs=9, rows=240)
    a, b, c = tables(spark, listed, runs, meta)
    feed, given = ChangeFeed(spark, str(tmp_path / "f"), grace_runs=0), set()
    feed.start(c)
    for upto in range(1, 10):
        given |= {tuple(r) for r in feed.process(a.where(f"run_no <= {upto}"), b.where(f"run_no <= {upto}").fillna("failed", ["status"])).collect()}
    assert given == brute(listed, runs, meta)[0] and 1 <= len(feed._pointer()["base"]) <= 3
    assert {tuple(r) for r in feed._base(feed._pointer()["base"]).collect() if r[0]} == set(brute(listed, runs, meta)[1].items())
