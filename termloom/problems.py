"""Registered queries of the core problems, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.incremental import ChangeFeed
from termloom.operators.references import orphan_references, orphan_report
from termloom.runtime import scratch_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """A feed that begins with doc_meta, asked once the log is complete."""
    feed = ChangeFeed(spark, scratch_path(spark, "feed"))
    feed.start(table(spark, d, "doc_meta"))
    changes = feed.fetch(table(spark, d, "scanned_files"), table(spark, d, "scan_runs")).select("run_no", "path")
    feed.ack()
    return changes


def p2_feed(spark: SparkSession, d: str) -> DataFrame:
    """The same while the log grows: a feed asked at four times, when some runs are over and the next is under way, with half of its files listed and no verdict yet."""
    listings, runs = table(spark, d, "scanned_files"), table(spark, d, "scan_runs")
    feed = ChangeFeed(spark, scratch_path(spark, "feed"))
    feed.start(table(spark, d, "doc_meta"))
    given = []
    for over in (3, 6, 9, None):
        rows, log = listings, runs
        if over is not None:
            half = (F.col("run_no") == over + 1) & (F.pmod(F.xxhash64("path"), F.lit(2)) == 0)
            rows = listings.where((F.col("run_no") <= over) | half)
            log = runs.where(F.col("run_no") <= over + 1).withColumn("status", F.when(F.col("run_no") <= over, F.col("status")))
        given.append(feed.fetch(rows, log).select("run_no", "path"))
        feed.ack()
    return reduce(DataFrame.unionByName, given)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "evaluation"), table(spark, d, "corpus_docs"), table(spark, d, "doc_meta"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p7_found(spark, d))


QUERIES = {"p2_found": p2_found, "p2_feed": p2_feed, "p7_found": p7_found, "p7_report": p7_report}

_P7 = """
WITH e AS (SELECT DISTINCT eval_id, labeled_at, unnest(relevant) AS ref FROM evaluation),
k AS (SELECT eval_id, labeled_at, ref, regexp_replace(ref, '^\\./', '') AS p FROM e WHERE ref <> ''),
r AS (SELECT eval_id, labeled_at, ref,
        CASE WHEN regexp_full_match(ref, '[0-9a-fA-F]{16}') THEN lower(ref)
             WHEN p LIKE 'corpus/%' THEN p ELSE 'corpus/' || p END AS key FROM k),
c AS (SELECT key, min(indexed_at) AS indexed_at FROM
        (SELECT id AS key, indexed_at FROM corpus_docs UNION ALL SELECT path, indexed_at FROM corpus_docs) GROUP BY key),
m AS (SELECT id AS key FROM doc_meta UNION SELECT path FROM doc_meta),
o AS (SELECT eval_id, ref, labeled_at,
        CASE WHEN c.key IS NULL AND m.key IS NULL THEN 'missing' WHEN c.key IS NULL THEN 'deleted'
             WHEN c.indexed_at > r.labeled_at THEN 'late' END AS kind
      FROM r LEFT JOIN c ON r.key = c.key LEFT JOIN m ON r.key = m.key)
SELECT DISTINCT eval_id, ref, kind, strftime(labeled_at, '%Y-%m') AS period FROM o WHERE kind IS NOT NULL
"""

_P2 = {
    # The prior version by window functions over islands of turns, not by the operator's anti-join.
    "p2_found": """
WITH t AS (SELECT run_no, row_number() OVER (ORDER BY run_no) AS turn FROM (SELECT DISTINCT run_no FROM scan_runs WHERE status = 'ok')),
l AS (SELECT turn, run_no, path, modified_time FROM (
        SELECT t.turn, t.run_no, path, modified_time,
               row_number() OVER (PARTITION BY t.turn, path ORDER BY listed_at DESC NULLS LAST, modified_time DESC NULLS LAST) AS k
        FROM scanned_files f JOIN t ON f.run_no = t.run_no WHERE path IS NOT NULL) WHERE k = 1
      UNION ALL
      SELECT 0, NULL, path, max(modified_time) FROM doc_meta WHERE path IS NOT NULL GROUP BY path),
i AS (SELECT *, turn - row_number() OVER (PARTITION BY path ORDER BY turn) AS island FROM l),
p AS (SELECT *, last_value(modified_time IGNORE NULLS) OVER (
        PARTITION BY path, island ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM i)
SELECT run_no, path FROM p WHERE turn > 0 AND modified_time IS NOT NULL AND (prior IS NULL OR prior <> modified_time)
""",
}
SQL = {
    **_P2,
    "p2_feed": _P2["p2_found"],
    "p7_found": _P7,
    "p7_report": f"SELECT kind, period, count(*) AS n FROM ({_P7}) GROUP BY kind, period",
}
