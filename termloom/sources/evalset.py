"""Relevance judgements from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.ids import path_id

_SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("relevant", T.ArrayType(T.StringType()))])


def read_evaluation(spark: SparkSession, file: str, root: str) -> DataFrame:
    """(query_no, query, relevant): relevant holds the stable ids of the paths below the corpus root."""
    rows = spark.read.schema(_SCHEMA).json(file, multiLine=True)
    one = rows.agg(F.collect_list(F.struct("query", "relevant")).alias("all")).select(F.posexplode("all").alias("query_no", "q"))
    flat = one.select("query_no", "q.query", F.explode_outer("q.relevant").alias("r"))
    ids = flat.withColumn("id", path_id(F.when(F.col("r").isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), F.col("r")))))
    return ids.groupBy("query_no", "query").agg(F.collect_set("id").alias("relevant"))
