"""The N best items of every group, whatever the size of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import BROADCAST_ROWS, cut

#: Score bins per power of two, and the exponent beyond which scores share the outermost bin.
PER_OCTAVE, MOST = 4, 1100.0


def score_bin(score: Column) -> Column:
    """A bin number that never falls as the score rises; at most 2 * PER_OCTAVE * MOST + 3 bins exist."""
    size = F.least(F.greatest(F.log2(F.abs(score)), F.lit(-MOST)), F.lit(MOST))
    step = (F.floor(size * PER_OCTAVE) + F.lit(int(MOST) * PER_OCTAVE + 1)).cast("int")
    below = (-F.floor(-size * PER_OCTAVE) + F.lit(int(MOST) * PER_OCTAVE + 1)).cast("int")
    return F.when(score > 0, step).when(score < 0, -below).otherwise(F.lit(0))


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def group_thresholds(scored: DataFrame, keys: list[str], n: int, heavy: DataFrame) -> DataFrame:
    """(keys, floor_bin) of the heavy groups: at least n different items lie in that bin or above it.

    The histogram has a row per group and bin with a mask of item hashes, of twice as many bits as n or more, in words of 64. Bits set in the union of the
    masks from the top down never exceed the number of different items, so repeated rows can't raise a threshold
    too far. A group whose items fill fewer than n bits gets none and keeps all its rows.
    """
    small = heavy.count() <= BROADCAST_ROWS
    side = (F.broadcast(heavy) if small else heavy).alias("h")
    words = max(1, -(-n // 32))
    place = F.pmod(F.xxhash64("_item"), F.lit(64 * words))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    masks = [F.coalesce(F.bit_or(F.when(F.floor(place / 64) == i, bit)), F.lit(0).cast("bigint")).alias(f"mask{i}") for i in range(words)]
    own = scored.alias("s").join(side, _same(keys, "s", "h"), "left_semi")
    histogram = own.groupBy(*keys, "_bin").agg(*masks)
    down = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = histogram.withColumn("distinct_at_least", reduce(lambda a, b: a + b, (F.bit_count(F.bit_or(f"mask{i}").over(down)) for i in range(words))))
    return reached.where(F.col("distinct_at_least") >= n).groupBy(*keys).agg(F.max("_bin").alias("floor_bin"))


def top_n(df: DataFrame, keys: list[str], item: str, score: str, n: int, rank: str = "rank_no", heavy_rows: int = 2000) -> DataFrame:
    """(keys, rank, item, score): the n best different items of each group, best first, ties by item ascending.

    An item's score is its highest in the group; rows with a null or NaN score or a null item don't count; 0.0 and
    -0.0 are equal; null keys form groups of their own; other columns are ignored; n < 1 or an empty table gives
    no rows.

    Groups of heavy_rows rows or more get a safe floor from their score histogram and drop the rows below it before anything is shuffled by item. What is left is
    reduced to one row per item, spread by group and item, then ranked exactly; each task passes on at most n
    rows of a group, so a group whose scores are all equal doesn't gather in one task either.
    """
    value = F.when(F.col(score) == 0, F.lit(0.0)).otherwise(F.col(score).cast("double"))
    counts = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull()
    scored = df.where(counts).select(*keys, F.col(item).alias("_item"), value.alias("_score"))
    binned = scored.withColumn("_bin", score_bin(F.col("_score")))
    left: DataFrame = scored
    if n >= 1:
        heavy = cut(scored.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= heavy_rows).select(*keys))
        floors = cut(group_thresholds(binned, keys, n, heavy))
        side = (F.broadcast(floors) if floors.count() <= BROADCAST_ROWS else floors).alias("f")
        above = F.col("f.floor_bin").isNull() | (F.col("s._bin") >= F.col("f.floor_bin"))
        kept = binned.alias("s").join(side, _same(keys, "s", "f"), "left").where(above)
        left = kept.select(*(F.col(f"s.{c}").alias(c) for c in (*keys, "_item", "_score")))
    best = left.groupBy(*keys, "_item").agg(F.max("_score").alias("_score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_score"), F.asc("_item"))
    ranked = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    return ranked.select(*keys, F.col("_rank").alias(rank), F.col("_item").alias(item), F.col("_score").alias(score))
