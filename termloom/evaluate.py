"""Ranking quality: Precision@5, Recall@10 and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.runtime import written


def per_query(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(query, precision_at_5, recall_at_10, reciprocal_rank), one row per judged query.

    ranked: query, rank (from 1), doc_id; judged: query, relevant array of ids. The divisor of precision is 5 whatever was found; an empty
    relevant set divides recall by 1; a query without results has zeros.
    """
    hits = ranked.join(judged, "query").where(F.array_contains("relevant", F.col("doc_id")))
    by_query = hits.groupBy("query").agg(
        F.sum((F.col("rank") <= 5).cast("int")).alias("in_5"),
        F.sum((F.col("rank") <= 10).cast("int")).alias("in_10"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
    )
    out = judged.join(by_query, "query", "left")
    size = F.greatest(F.coalesce(F.size("relevant"), F.lit(0)), F.lit(1))
    return out.select(
        "query",
        (F.coalesce("in_5", F.lit(0)) / 5).alias("precision_at_5"),
        (F.coalesce("in_10", F.lit(0)) / size).alias("recall_at_10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: queries, precision_at_5, recall_at_10, mrr."""
    return per_query(ranked, judged).agg(
        F.count("*").alias("queries"), F.avg("precision_at_5").alias("precision_at_5"), F.avg("recall_at_10").alias("recall_at_10"), F.avg("reciprocal_rank").alias("mrr")
    )


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the value at position trunc(p * (n - 1)) of the sorted column, nulls left out; null for no values.

    Values are ranged over partitions; only the one partition that holds the position is sorted, no column is gathered.
    """
    known = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    ranged = written(known.repartitionByRange("value").select("value", F.spark_partition_id().alias("part")), "ranged")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # a row per partition
    at = int(p * (sum(n for _, n in sizes) - 1)) if sizes else 0
    for part, n in sizes:
        if at < n:
            return ranged.where(F.col("part") == part).select("value").orderBy("value").offset(at).limit(1)
        at -= n
    return ranged.agg(F.max("value").alias("value"))
