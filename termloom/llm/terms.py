"""Term statistics of a collection: clean postings, corpus frequencies with marks, term weights per record."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.runtime import cut

K1, B = 1.2, 0.75


def clean_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf): one row per term and record, from the row with the latest indexed_at.

    tf is term_frequency or else the size of positions, null where both are null (such a record holds the
    term, how often is unknown). Rows without a term or doc_id, and empty terms, don't count. Of rows of the same time the
    greatest tf counts; a null time is the oldest. Built as an aggregate that combines before the shuffle.
    """
    tf = F.coalesce(F.col("term_frequency"), F.when(F.col("positions").isNotNull(), F.size("positions")))
    rows = postings.where((F.col("term") != "") & F.col("doc_id").isNotNull()).select("term", "doc_id", F.struct(F.col("indexed_at").alias("at"), tf.alias("tf")).alias("v"))
    return rows.groupBy("term", "doc_id").agg(F.max("v").alias("v")).select("term", "doc_id", F.col("v.tf").alias("tf"))


def collection(stats: DataFrame) -> DataFrame:
    """One row: n (records), avgdl (terms per record); 0 and 0.0 for an empty table."""
    n = F.coalesce(F.sum("document_count"), F.lit(0))
    total = F.coalesce(F.sum("total_tokens"), F.lit(0))
    return stats.agg(n.alias("n"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avgdl"))


def term_frequencies(clean: DataFrame) -> DataFrame:
    """(term, occurrences, df): sums over all records, combined by hash in each task before the shuffle."""
    return clean.groupBy("term").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("occurrences"), F.count("*").alias("df"))


def marked_frequencies(postings: DataFrame, stats: DataFrame, rare_df: int = 2, common_share: float = 0.38) -> DataFrame:
    """(term, occurrences, df, mark): mark is `rare` for df <= rare_df, `common` for df > common_share * N, else null.

    A term that is both is `rare`. Empty tables give no rows.
    """
    n = collection(stats).select("n").scalar()
    mark = F.when(F.col("df") <= rare_df, "rare").when(F.col("df") > common_share * n, "common")
    return term_frequencies(clean_postings(postings)).withColumn("mark", mark)


def saturated_tf(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """tf saturated and normalised by record length; rises strictly with tf, 0 for tf <= 0."""
    norm = F.when(avgdl > 0, length / avgdl).otherwise(F.lit(1.0))
    return F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))).otherwise(F.lit(0.0))


def relevance_idf(df: Column, n: Column) -> Column:
    """Probabilistic relevance weight of a term held by df of n records; positive, falls as df rises."""
    return F.log1p((F.greatest(n - df, F.lit(0)) + 0.5) / (df + 0.5))


def term_weights(postings: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(term, doc_id, tf, df, length, n, avgdl, weight): how characteristic each term is of each record.

    weight = idf * saturated, length-normalised tf; a record's length is the sum of its clean tf. Null tf gives
    a null weight.
    """
    clean = cut(clean_postings(postings))  # read by the lengths, the frequencies and the rows themselves
    lengths = clean.groupBy("doc_id").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
    all_n = collection(stats)
    rows = (
        clean.join(term_frequencies(clean).select("term", "df"), "term")
        .join(lengths, "doc_id")
        .withColumns({"n": all_n.select("n").scalar(), "avgdl": all_n.select("avgdl").scalar()})
    )
    weight = relevance_idf(F.col("df"), F.col("n")) * saturated_tf(F.col("tf"), F.col("length"), F.col("avgdl"), k1, b)
    return rows.select("term", "doc_id", "tf", "df", "length", "n", "avgdl", F.when(F.col("tf").isNotNull(), weight).alias("weight"))


def distinctive_terms(postings: DataFrame, stats: DataFrame, factor: float = 2.0, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, term, weight): pairs whose weight reaches what the least sufficient tf would weigh in that record.

    A pair suffices if (1 + ln tf) * (ln(n / df) + 1) >= factor * (1 + ln n). For a given df that asks for a least
    real tf; since the weight rises strictly with tf, the pair's weight reaches the weight of that tf exactly
    when it suffices. The weights are compared with a margin for rounding, then the rule is checked as stated.
    """
    w = term_weights(postings, stats, k1, b)
    idf = F.log(F.col("n") / F.col("df")) + 1
    bound = factor * (1 + F.log(F.col("n")))
    least_tf = F.exp(F.least(bound / idf - 1, F.lit(math.log(1e15))))
    needed = relevance_idf(F.col("df"), F.col("n")) * saturated_tf(least_tf, F.col("length"), F.col("avgdl"), k1, b)
    reached = w.where((F.col("n") > 0) & (F.col("tf") > 0) & (idf > 0) & (F.col("weight") >= needed * (1 - 1e-9)))
    return reached.where((1 + F.log("tf")) * idf >= bound * (1 - 1e-12)).select("doc_id", "term", "weight")
