"""Processing only new or changed records.

`ChangeFeed` is for a live log: each call rereads from the oldest run that was still open at the last call, or from the first state when an older
run has rows not seen before, and removes by an anti-join against a processed ledger whatever was given out before.
`replay_changes` is its plan for the runs that are read, by an anti-join of (path, version) pairs against the ledger of the run before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.files import Files
from termloom.runtime import cut


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key, the one with the greatest `order`; ties go to the greatest values, null order is least.

    An aggregate over a struct: combines before the shuffle, so a key of any weight costs one row per task.
    """
    got = df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_latest"))
    return got.select(*keys, *(F.col(f"_latest.{v}").alias(v) for v in values))


def ok_runs(runs: DataFrame) -> DataFrame:
    """(run_no, turn): successful runs numbered from 1 by run_no. The log has one row per run, repeated rows count once."""
    done = runs.where((F.col("status") == "ok") & F.col("run_no").isNotNull()).select("run_no").distinct()
    return done.withColumn("turn", F.row_number().over(Window.orderBy("run_no")))


def _ledger(listed: DataFrame) -> DataFrame:
    """Adds to (path, turn, modified_time) the version the state holds after that turn.

    Turns in a row form an island; inside it a null listing keeps the version before, a gap forgets the path.
    A path has at most one row per run, so no window frame grows with the data.
    """
    by_path = Window.partitionBy("path").orderBy("turn")
    island = listed.withColumn("_island", F.col("turn") - F.row_number().over(by_path))
    so_far = Window.partitionBy("path", "_island").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return island.withColumn("version", F.last("modified_time", ignorenulls=True).over(so_far))


def listings_by_turn(listings: DataFrame, runs: DataFrame, initial: DataFrame) -> DataFrame:
    """(path, turn, run_no, modified_time), one row per path and successful run; turn 0 is the first state."""
    own = listings.where(F.col("path").isNotNull()).select("run_no", "path", "modified_time", "listed_at")
    listed = own.join(ok_runs(runs), "run_no")
    last = latest(listed, ["path", "turn", "run_no"], "listed_at", ["modified_time"])
    first = initial.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("modified_time").alias("modified_time"))
    return last.unionByName(first.select("path", F.lit(0).alias("turn"), F.lit(None).cast("int").alias("run_no"), "modified_time"))


def replay_changes(listings: DataFrame, runs: DataFrame, initial: DataFrame) -> DataFrame:
    """Every (run_no, path, modified_time) that is new or changed against the successful run before it.

    listings: run_no, path, modified_time, listed_at; runs: run_no, status; initial: path, modified_time. Other
    columns are ignored. Of several rows of a path in a run the latest listed_at counts (a tie: the greatest
    modified_time); rows without path or run_no, and rows of runs that aren't ok, change nothing; a null
    modified_time keeps the former state; empty tables give no rows.

    The listings are read and reduced once; what remains, a row per path and successful run, is cut from its lineage and serves as candidates and as ledger. Path and
    turn are the anti-join's keys, so that it compares each row with one entry of the ledger, however many runs there are.
    """
    state = cut(_ledger(listings_by_turn(listings, runs, initial)))
    seen = state.where(F.col("version").isNotNull()).select("path", (F.col("turn") + 1).alias("turn"), "version").alias("l")
    new = state.where((F.col("turn") > 0) & F.col("modified_time").isNotNull()).select("run_no", "path", "turn", "modified_time").alias("c")
    same = (F.col("c.path") == F.col("l.path")) & (F.col("c.turn") == F.col("l.turn")) & (F.col("c.modified_time") == F.col("l.version"))
    return new.join(seen, same, "left_anti").select("run_no", "path", "modified_time")


def state_after(listings: DataFrame, runs: DataFrame, initial: DataFrame) -> DataFrame:
    """(path, modified_time): the state once the last successful run of the log has been applied."""
    state = _ledger(listings_by_turn(listings, runs, initial))
    # Island -1 begins with the first state; a path outside it whose listings had no time never came in.
    state = state.where(F.col("version").isNotNull() | (F.col("_island") == -1))
    last = ok_runs(runs).agg(F.coalesce(F.max("turn"), F.lit(0)).alias("turn"))
    return state.join(F.broadcast(last), "turn").select("path", F.col("version").alias("modified_time"))


def open_from(runs: DataFrame, after: int) -> int:
    """The oldest run above `after` without a verdict (status null), else the one after the last run. One row per run is read."""
    row = runs.where(F.col("run_no") > after).agg(
        F.min(F.when(F.col("status").isNull(), F.col("run_no"))).alias("open"), F.max("run_no").alias("last")
    ).first()
    return row["open"] if row["open"] is not None else max(after, row["last"] or after) + 1


def _ok_rows(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """The different listed rows of the successful runs, and a row without path for each such run."""
    ok = ok_runs(runs).select("run_no")
    own = listings.select("run_no", "path", "modified_time", "listed_at").join(ok, "run_no", "left_semi")
    marks = ok.select("run_no", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns[1:]))
    return own.unionByName(marks).distinct()


class ChangeFeed:
    """Gives out each change exactly once, over calls that may fail anywhere and rows and verdicts that come however late.

    fetch() gives the changes that weren't given out before; ack() says that the caller has used them. A caller that dies in between gets them again.
    A change that a late row makes needless after it was given out is not taken back.

    Folder layout: `v=0/base` (the first state), `v=<n>/changes` (what a call gave out), `v=<n>/seen` (rows of successful runs before the reread window that
    no version before has), `v=<n>/base` (by how much the state before the window changed, or all of it after MERGE_AT such parts) and `_CURRENT`, the one-file commit, which lists the folders in force: a call writes a new
    version aside, ack() replaces the pointer. Ledgers and states are thus written as they grow, not anew.
    """

    #: Parts of the state after which it is written as one again.
    MERGE_AT = 8

    def __init__(self, spark: SparkSession, folder: str, grace_runs: int = 1):
        """grace_runs: so many closed runs are reread besides; later rows of theirs don't need the whole log to be read again."""
        self.spark, self.folder, self.grace = spark, folder.rstrip("/"), grace_runs
        self.files = Files(spark)
        self._pending: dict | None = None

    def _pointer(self) -> dict | None:
        text = self.files.read(f"{self.folder}/_CURRENT")
        return json.loads(text) if text else None

    def start(self, initial: DataFrame) -> None:
        """Begins from a first state; does nothing when the feed exists."""
        if self._pointer() is None:
            v = f"{self.folder}/v=0-{uuid.uuid4().hex[:8]}"
            initial.select("path", "modified_time", F.lit(True).alias("present"), F.lit(0).alias("n")).write.parquet(f"{v}/base")
            self._commit({"n": 0, "low": 0, "start": v, "given": [], "base": [v]})

    def _commit(self, pointer: dict) -> None:
        self.files.write(f"{self.folder}/_CURRENT", json.dumps(pointer))

    def _union(self, folders: list[str], what: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{v}/{what}" for v in folders))

    def _base(self, folders: list[str]) -> DataFrame:
        """The state that its parts add up to: of each path the newest part's row."""
        rows = self._union(folders, "base")
        if len(folders) > 1:
            newest = rows.groupBy("path").agg(F.max(F.struct("n", "present", "modified_time")).alias("r"))
            rows = newest.select("path", "r.modified_time", "r.present")
        return rows.where("present").select("path", "modified_time")

    def fetch(self, listings: DataFrame, runs: DataFrame) -> DataFrame:
        """The changes not given out before, (run_no, path, modified_time); they are given out again until ack() is called."""
        now = self._pointer()
        if now is None:
            raise ValueError("start() gives the feed its first state")
        if "given" not in now:
            raise ValueError("this feed was written by an earlier format; start() a new one")
        low, base = now["low"], now["base"]
        if now["given"]:
            own = _ok_rows(listings.where(F.col("run_no") < low), runs.where(F.col("run_no") < low))
            if not own.subtract(self._union(now["given"], "seen")).isEmpty():
                low, base = 0, [now["start"]]
        state = self._base(base)
        window: Column = F.col("run_no") >= low
        rows, log = listings.where(window), runs.where(window)
        changes = replay_changes(rows, log, state)
        if now["given"]:
            changes = changes.join(self._union(now["given"], "changes"), ["run_no", "path", "modified_time"], "left_anti")
        n = now["n"] + 1
        v = f"{self.folder}/v={n}-{uuid.uuid4().hex[:8]}"
        changes.write.parquet(f"{v}/changes")
        then = max(low, open_from(runs, low - 1) - self.grace)
        before = F.col("run_no") < then
        closed = _ok_rows(listings.where(before), runs.where(before))
        (closed.subtract(self._union(now["given"], "seen")) if now["given"] else closed).write.parquet(f"{v}/seen")
        state_now, was = state_after(rows.where(before), log.where(before), state), now["base"]
        if len(was) >= self.MERGE_AT:
            was, part = [], state_now.select("path", "modified_time", F.lit(True).alias("present"))
        else:
            a, b = state_now.withColumn("present", F.lit(True)).alias("a"), self._base(was).withColumn("present", F.lit(True)).alias("b")
            both = a.join(b, F.col("a.path").eqNullSafe(F.col("b.path")), "full_outer")
            differ = ~(F.col("a.present").eqNullSafe(F.col("b.present")) & F.col("a.modified_time").eqNullSafe(F.col("b.modified_time")))
            part = both.where(differ).select(F.coalesce("a.path", "b.path").alias("path"), "a.modified_time", F.col("a.present").isNotNull().alias("present"))
        part.withColumn("n", F.lit(n)).write.parquet(f"{v}/base")
        self._pending = {"n": n, "low": then, "start": now["start"], "given": [*now["given"], v], "base": [*was, v]}
        return self.spark.read.parquet(f"{v}/changes")

    def ack(self) -> None:
        """Takes what fetch() gave as used: it isn't given out again."""
        if self._pending is not None:
            self._commit(self._pending)
            self._pending = None

    def process(self, listings: DataFrame, runs: DataFrame) -> DataFrame:
        """fetch() and ack() at once, for a caller that can't fail before the rows are used or has its own way to get them again (they stay in the feed's folder)."""
        fresh = self.fetch(listings, runs)
        self.ack()
        return fresh
