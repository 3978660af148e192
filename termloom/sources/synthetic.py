"""Random corpora for benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary of generated documents.
WORDS = (
    "database index query cache memory network server client protocol packet router switch kernel thread process "
    "lock table column row join schema vector matrix gradient layer token parser compiler buffer stream"
).split()


def synthetic_corpus(spark: SparkSession, documents: int, words: int = 120, seed: int = 42) -> DataFrame:
    """(doc_id, content): a heading, then `words` words drawn evenly by a seeded generator; the same for the same arguments."""
    vocabulary = F.array(*map(F.lit, WORDS))

    def word(i: Column) -> Column:
        return F.get(vocabulary, F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(WORDS))).cast("int"))

    drawn = F.transform(F.sequence(F.lit(1), F.lit(words)), word)
    return spark.range(documents).select(F.col("id").alias("doc_id"), F.concat(F.lit("# Document "), F.col("id").cast("string"), F.lit("\n"), F.array_join(drawn, " ")).alias("content"))
