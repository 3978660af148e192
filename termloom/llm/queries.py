"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bpe import token_ids
from termloom.llm.markup import clean_markup
from termloom.llm.mixing import mix
from termloom.llm.neardup import near_duplicate_links, near_duplicate_pairs
from termloom.llm.terms import distinctive_terms, marked_frequencies, term_weights
from termloom.llm.topn import top_n
from termloom.llm.sql import SQL  # noqa: F401
from termloom.llm.truncation import truncation, truncation_rates
from termloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms(table(spark, d, "postings"), table(spark, d, "collection_stats")).select("doc_id", "term")


def p1_weights(spark: SparkSession, d: str) -> DataFrame:
    w = term_weights(table(spark, d, "postings"), table(spark, d, "collection_stats"))
    return w.select("doc_id", "term", "tf", "df", "length", F.round("weight", 6).alias("weight"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "corpus_docs"), "id", "content", words=3, threshold=0.6, rows=3).select("id_a", "id_b")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """The stages' usual setting, five words and 0.8, one row per document."""
    return near_duplicate_links(table(spark, d, "documents"), "doc_id", "text", words=5, threshold=0.8, every=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(table(spark, d, "corpus_docs"), "id", ["content", "title"]).where(F.col("fall") > 0).select("id", "field")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(table(spark, d, "corpus_docs"), "id", ["content", "title"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = marked_frequencies(table(spark, d, "postings"), table(spark, d, "collection_stats"))
    return m.where(F.col("mark").isNotNull()).select("term", "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return marked_frequencies(table(spark, d, "postings"), table(spark, d, "collection_stats"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n(table(spark, d, "search_results"), ["query", "ranker"], "document_id", "score", 5)
    return best.select("query", "ranker", "rank_no", "document_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation(table(spark, d, "documents")).where("is_cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(truncation(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_weights, p3_found, p3_links, p4_found, p4_clean, p5_found, p5_frequencies, p6_found, p8_ids, p9_mix, p9_shares, p10_found, p10_rates)}
