"""Positional inverted index: build, diff and apply as relations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.analyze import STOP_WORDS, kept_tokens, py_lower, py_stem, py_tokens, stem


@dataclass(frozen=True)
class Index:
    """docs(doc_id, path, title, token_count, modified_time, content), postings(term, doc_id, tf, positions, length),
    terms(term, df, cf), stats(n_docs, total_tokens, avgdl)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def document_postings(corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(term, doc_id, tf, positions, length): one row per term and document, positions ascending; length is the document's, so that ranking needs no join.

    All tokens of a document are in one row, so its postings are formed right there, in Arrow batches and without a shuffle. `postings_by_shuffle`
    gives the same with built-in functions only, at the price of moving every token's group.
    """
    stops = frozenset(stop_words)

    def analyzed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                terms, rows, positions, lengths = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    at: dict[str, list[int]] = {}
                    n = 0
                    for word in py_tokens(py_lower(text)) if text else ():
                        term = known.get(word)
                        if term is None:
                            term = "" if word in stops else py_stem(word)
                            if len(known) < 200_000:
                                known[word] = term
                        if term:
                            at.setdefault(term, []).append(n)
                            n += 1
                    terms += at
                    rows += [i] * len(at)
                    positions += at.values()
                    lengths += [n] * len(at)
                tf = pa.array([len(p) for p in positions], pa.int32())
                columns = [pa.array(terms, pa.string()), batch.column(0).take(pa.array(rows, pa.int32())), tf, pa.array(positions, pa.list_(pa.int32())), pa.array(lengths, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "positions", "length"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    return corpus.select("doc_id", "content").mapInArrow(analyzed, f"term string, doc_id {kind}, tf int, positions array<int>, length int")


def postings_by_shuffle(corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """The same as document_postings, inside the JVM: explode, stem, group."""
    words = corpus.select("doc_id", kept_tokens(F.col("content"), stop_words).alias("words"))
    kept = words.select("doc_id", F.size("words").alias("length"), F.posexplode("words").alias("pos", "word"))
    stemmed = kept.select("doc_id", "length", "pos", stem(F.col("word")).alias("term"))
    counted = stemmed.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.max("length").alias("length"))
    return counted.select("term", "doc_id", "tf", "positions", "length")


def document_metadata(corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    return corpus.select("doc_id", "path", "title", F.size(kept_tokens(F.col("content"), stop_words)).alias("token_count"), "modified_time", "content")


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def collection_statistics(docs: DataFrame) -> DataFrame:
    """One row, zeros for an empty collection."""
    n, total = F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint")
    return docs.agg(n.alias("n_docs"), total.alias("total_tokens"), F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)).alias("avgdl"))


def build_index(corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> Index:
    """corpus: doc_id, path, title, content, modified_time (see sources)."""
    postings, docs = document_postings(corpus, stop_words), document_metadata(corpus, stop_words)
    return with_statistics(docs, postings)


def with_statistics(docs: DataFrame, postings: DataFrame) -> Index:
    return Index(docs, postings, term_statistics(postings), collection_statistics(docs))


def index_diff(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, change): `added`, `updated`, `deleted` or `unchanged` by path and modified_time. A scan row whose
    `error` is set keeps the document it had and is an `error`."""
    error = F.col("error") if "error" in scan.columns else F.lit(None).cast("string")
    s = scan.select("doc_id", F.col("path").alias("s_path"), F.col("modified_time").alias("s_time"), error.alias("s_error"))
    d = docs.select("doc_id", F.col("path").alias("d_path"), F.col("modified_time").alias("d_time"))
    same = F.col("s_path").eqNullSafe(F.col("d_path")) & F.col("s_time").eqNullSafe(F.col("d_time"))
    change = (
        F.when(F.col("in_scan").isNull(), "deleted")
        .when(F.col("in_docs").isNotNull() & same, "unchanged")
        .when(F.col("s_error").isNotNull(), "error")
        .when(F.col("in_docs").isNull(), "added")
        .otherwise("updated")
    )
    both = s.withColumn("in_scan", F.lit(True)).join(d.withColumn("in_docs", F.lit(True)), "doc_id", "full_outer")
    return both.select("doc_id", change.alias("change"))


@dataclass(frozen=True)
class Delta:
    """What changes an index: `fresh` (a corpus) comes in, the documents whose ids are in `gone` leave, also those that come in anew."""

    fresh: DataFrame
    gone: DataFrame


def delta_of(diff: DataFrame, corpus: DataFrame) -> Delta:
    """The change that a diff asks for: only added and updated documents come in, changed and deleted ones leave."""
    fresh = corpus.join(diff.where(F.col("change").isin("added", "updated")).select("doc_id"), "doc_id", "left_semi")
    return Delta(fresh, diff.where(F.col("change").isin("updated", "deleted")).select("doc_id"))


def apply_changes(index: Index, diff: DataFrame, corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> Index:
    """The index after a diff: changed and deleted documents leave by an anti-join, only added and updated ones are analyzed."""
    change = delta_of(diff, corpus)
    fresh, gone = change.fresh, change.gone
    docs = index.docs.join(gone, "doc_id", "left_anti").unionByName(document_metadata(fresh, stop_words))
    postings = index.postings.join(gone, "doc_id", "left_anti").unionByName(document_postings(fresh, stop_words))
    return with_statistics(docs, postings)


def upsert(index: Index, corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> Index:
    """Documents of the corpus replace those with the same id."""
    ids = corpus.select("doc_id")
    docs = index.docs.join(ids, "doc_id", "left_anti").unionByName(document_metadata(corpus, stop_words))
    postings = index.postings.join(ids, "doc_id", "left_anti").unionByName(document_postings(corpus, stop_words))
    return with_statistics(docs, postings)


def delete(index: Index, ids: DataFrame) -> Index:
    """Without the documents whose doc_id is in `ids`; unknown ids change nothing."""
    gone = ids.select("doc_id")
    return with_statistics(index.docs.join(gone, "doc_id", "left_anti"), index.postings.join(gone, "doc_id", "left_anti"))


def size_estimate(index: Index) -> DataFrame:
    """One row: documents, terms, total_tokens, average_document_length, index_size_bytes."""
    def text(c: str) -> F.Column:
        return F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))

    of_docs = index.docs.agg(F.coalesce(F.sum(text("doc_id") + text("path") + text("title") + 24), F.lit(0)).alias("b")).scalar()
    per_posting = index.postings.groupBy("term").agg(F.sum(8 + 4 * F.size("positions")).alias("p"))
    of_terms = per_posting.agg(F.count("*").alias("t"), F.coalesce(F.sum(F.octet_length("term") + 8 + F.col("p")), F.lit(0)).alias("b"))
    return of_terms.select(
        index.stats.select("n_docs").scalar().alias("documents"),
        F.col("t").alias("terms"),
        index.stats.select("total_tokens").scalar().alias("total_tokens"),
        index.stats.select("avgdl").scalar().alias("average_document_length"),
        (F.col("b") + of_docs).cast("bigint").alias("index_size_bytes"),
    )
