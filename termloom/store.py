"""Index snapshots: immutable versions in Parquet and one pointer file that is replaced atomically.

A version is a list of segments, each in the folder of the version that wrote it: docs, postings, and what it adds to the statistics of terms and of the collection.
A later segment also names documents of earlier ones that are gone, and counts them off; an update thus writes the changed documents only. Segments of like size are
merged as they become many, so that their number grows as the logarithm of the documents.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.files import Files
from termloom.operators.index import Delta, Index, collection_statistics, document_metadata, document_postings, term_statistics
from termloom.runtime import at_once

#: A merge takes in a segment of up to so many times the documents of all newer ones, and is due with so many of these.
MERGE_FACTOR, MERGE_AT = 3, 4
#: Share of documents that are gone but still stored at which everything is written anew.
GONE_SHARE = 0.3

# Name and version of the format.
FORMAT, VERSION = "termloom-index", 2


class IndexLoadError(RuntimeError):
    """A snapshot that is missing, damaged or of another version."""


def save_index(index: Index, path: str, partitions: int = 0, keep: int = 2) -> str:
    """Writes a new version of one segment below path and makes it the current one; returns its folder.

    Postings are range-partitioned and sorted by term, then document: a lookup by term prunes files and row groups, and the
    documents of a hot term spread over partitions. Readers of older versions are not disturbed; all but the `keep` newest are removed.
    """
    spark = index.docs.sparkSession
    files, path, name = _begin(spark, path)
    folder = f"{path}/{name}"
    docs, postings = _write_rows(index.docs, index.postings, folder, partitions)
    at_once(
        lambda: term_statistics(postings).sortWithinPartitions("term").write.parquet(f"{folder}/terms"),
        lambda: _sums(docs).coalesce(1).write.parquet(f"{folder}/stats"),
    )
    files.delete(f"{folder}/_unsorted")
    _commit(files, path, name, [_segment(spark, folder, name, 0)], keep)
    return folder


def update_index(spark: SparkSession, path: str, change: Delta, stop_words: tuple[str, ...], keep: int = 2) -> str:
    """A new version with a change applied to the current one: one more segment, of the size of the change; returns its folder.

    What leaves is read again from its stored text to be counted off. Applying a change twice gives the same index.
    """
    now = load_index(spark, path)
    segments = _segments(spark, path)
    files, path, name = _begin(spark, path)
    folder = f"{path}/{name}"
    ids = change.gone.select("doc_id").unionByName(change.fresh.select("doc_id")).distinct()
    left = now.docs.join(ids, "doc_id", "left_semi").select("doc_id", "content", "token_count")
    left.write.parquet(f"{folder}/gone")
    left = spark.read.schema(left.schema).parquet(f"{folder}/gone")
    docs, postings = _write_rows(document_metadata(change.fresh, stop_words), document_postings(change.fresh, stop_words), folder)
    off = term_statistics(document_postings(left, stop_words)).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    less = _sums(left).select(*((-F.col(c)).alias(c) for c in ("n_docs", "total_tokens")))
    at_once(
        lambda: _added(term_statistics(postings).unionByName(off)).sortWithinPartitions("term").write.parquet(f"{folder}/terms"),
        lambda: _total(_sums(docs).unionByName(less)).coalesce(1).write.parquet(f"{folder}/stats"),
    )
    files.delete(f"{folder}/_unsorted")
    segments.append(_segment(spark, folder, name, left.count()))
    _commit(files, path, name, segments, keep)
    return _merge_if_due(spark, path, segments, keep) or folder


def _merge_if_due(spark: SparkSession, path: str, segments: list[dict], keep: int) -> str | None:
    """Merges the newest segments of like size once there are MERGE_AT, or all once many of their documents are gone."""
    docs, gone = sum(s["docs"] for s in segments), sum(s["gone"] for s in segments)
    first, newer = len(segments) - 1, segments[-1]["docs"]
    while first > 0 and segments[first - 1]["docs"] <= MERGE_FACTOR * max(newer, 1):
        first -= 1
        newer += segments[first]["docs"]
    if gone > GONE_SHARE * docs:
        first = 0
    elif len(segments) - first < MERGE_AT:
        return None
    files, path, name = _begin(spark, path)
    folder, tail = f"{path}/{name}", segments[first:]
    docs_now, postings_now = _live(spark, path, tail, "docs"), _live(spark, path, tail, "postings")
    _write_rows(docs_now, postings_now, folder)
    parts = {what: [spark.read.parquet(f"{path}/{s['name']}/{what}") for s in tail] for what in ("terms", "stats")}
    at_once(
        lambda: _added(_union(parts["terms"])).sortWithinPartitions("term").write.parquet(f"{folder}/terms"),
        lambda: _total(_union(parts["stats"])).coalesce(1).write.parquet(f"{folder}/stats"),
    )
    files.delete(f"{folder}/_unsorted")
    removed = 0
    if first:  # what the merged segments take from older ones, they take together
        lost = _union([spark.read.parquet(f"{path}/{s['name']}/gone").select("doc_id") for s in tail]).distinct()
        lost.write.parquet(f"{folder}/gone")
        removed = sum(s["gone"] for s in tail)
    _commit(files, path, name, [*segments[:first], _segment(spark, folder, name, removed)], keep)
    return folder


def _write_rows(docs: DataFrame, postings: DataFrame, folder: str, partitions: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes documents and postings below folder; returns them as read from there, the postings as they were before they were sorted."""
    spark, parts = docs.sparkSession, (partitions,) if partitions else ()
    # Postings are written as they come first: ranges are sampled from a read of that, not from a second analysis.
    at_once(lambda: docs.write.parquet(f"{folder}/docs"), lambda: postings.write.parquet(f"{folder}/_unsorted"))
    unsorted = spark.read.schema(postings.schema).parquet(f"{folder}/_unsorted")
    unsorted.repartitionByRange(*parts, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
    return spark.read.schema(docs.schema).parquet(f"{folder}/docs"), unsorted


def _sums(docs: DataFrame) -> DataFrame:
    return collection_statistics(docs).select("n_docs", "total_tokens")


def _total(sums: DataFrame) -> DataFrame:
    return sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "total_tokens")))


def _added(terms: DataFrame) -> DataFrame:
    summed = terms.groupBy("term").agg(F.sum("df").cast("bigint").alias("df"), F.sum("cf").cast("bigint").alias("cf"))
    return summed.where((F.col("df") != 0) | (F.col("cf") != 0))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _live(spark: SparkSession, path: str, segments: list[dict], what: str) -> DataFrame:
    """Rows of all segments without those of documents that a later segment names as gone."""
    rows: list[DataFrame] = []
    for i, s in enumerate(segments):
        part = spark.read.parquet(f"{path}/{s['name']}/{what}")
        later = [spark.read.parquet(f"{path}/{t['name']}/gone").select("doc_id") for t in segments[i + 1 :] if t["gone"]]
        rows.append(part.join(_union(later), "doc_id", "left_anti").select(*part.columns) if later else part)
    return _union(rows)


def _begin(spark: SparkSession, path: str) -> tuple[Files, str, str]:
    """Files, path and a new version's name."""
    files, path = Files(spark), path.rstrip("/")
    files.make(path)
    versions = _versions(files, path)
    return files, path, f"v={_number(versions[-1]) + 1 if versions else 1}-{uuid.uuid4().hex[:8]}"


def _segment(spark: SparkSession, folder: str, name: str, gone: int) -> dict:
    return {"name": name, "docs": spark.read.parquet(f"{folder}/docs").count(), "gone": gone}


def _commit(files: Files, path: str, name: str, segments: list[dict], keep: int) -> None:
    files.write(f"{path}/{name}/_META.json", json.dumps({"format": FORMAT, "version": VERSION, "segments": segments}))
    files.write(f"{path}/_CURRENT", name)
    versions = _versions(files, path)
    used = set(versions[-keep:])
    for v in versions[-keep:]:
        try:
            used |= {s["name"] for s in json.loads(files.read(f"{path}/{v}/_META.json") or "{}").get("segments", [])}
        except ValueError:
            continue
    for v in versions:
        if v not in used:
            files.delete(f"{path}/{v}")


def _number(version: str) -> int:
    return int(version[2:].split("-")[0])


def _versions(files: Files, path: str) -> list[str]:
    return sorted((x for x in files.names(path) if x.startswith("v=")), key=_number)


def current_version(spark: SparkSession, path: str) -> str:
    name = Files(spark).read(f"{path.rstrip('/')}/_CURRENT")
    if not name:
        raise IndexLoadError(f"no index at {path}")
    return name.strip()


def _segments(spark: SparkSession, path: str) -> list[dict]:
    """The current version's segments, oldest first. Raises IndexLoadError."""
    folder = f"{path.rstrip('/')}/{current_version(spark, path)}"
    try:
        meta = json.loads(Files(spark).read(f"{folder}/_META.json") or "null")
        kind, version = meta["format"], meta["version"]
    except (ValueError, TypeError, KeyError) as e:
        raise IndexLoadError(f"damaged index at {path}: {e}") from e
    if kind != FORMAT:
        raise IndexLoadError(f"not an index: {path}")
    if version != VERSION:
        raise IndexLoadError(f"index version {version}, expected {VERSION}")
    return meta["segments"]


def load_index(spark: SparkSession, path: str) -> Index:
    """The current version. Raises IndexLoadError for whatever can't be read as one."""
    segments, path = _segments(spark, path), path.rstrip("/")
    try:
        docs, postings = (_live(spark, path, segments, what) for what in ("docs", "postings"))
        terms, sums = ([spark.read.parquet(f"{path}/{s['name']}/{what}") for s in segments] for what in ("terms", "stats"))
    except Exception as e:  # a path that is gone is a PySparkException, a file that isn't Parquet a raw Java error
        raise IndexLoadError(f"damaged index at {path}: {type(e).__name__}") from (e if isinstance(e, PySparkException) else None)
    total = _total(_union(sums)) if len(sums) > 1 else sums[0]
    average = F.coalesce(F.col("total_tokens") / F.nullif(F.col("n_docs"), F.lit(0)), F.lit(0.0))
    return Index(docs, postings, _added(_union(terms)) if len(terms) > 1 else terms[0], total.select("n_docs", "total_tokens", average.alias("avgdl")))
