"""Mixing sources to target weights: capped water-filling over token counts, seeded whole and partial repetitions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.bpe import TOKENIZERS, token_count
from termloom.runtime import BROADCAST_ROWS, cut

#: Bits of the hash by which a partial repetition's cut is located at each step, and steps: what is ordered in the end is a 2**24th of a source.
BITS, STEPS = 12, 2


@dataclass(frozen=True)
class Share:
    """One source of a mix: its weight, its tokens, how often it may be repeated."""

    weight: float
    tokens: int
    max_repeats: int


def water_fill(sources: Mapping[str, Share], total: float) -> dict[str, float]:
    """Tokens to draw per source.

    The total is split in proportion to the weights; a source that would have to be repeated more than allowed is clamped at
    its cap and its excess goes to the others, in proportion, until nothing exceeds a cap. If all caps together stay below
    the total, every source is at its cap. Sources without weight, tokens or repeats draw nothing.
    """
    caps = {s: float(x.tokens) * x.max_repeats for s, x in sources.items() if x.weight > 0 and x.tokens > 0 and x.max_repeats > 0}
    out = dict.fromkeys(sources, 0.0)
    left, open_ = float(total), set(caps)
    while open_ and left > 0:
        weight = sum(sources[s].weight for s in sorted(open_))
        full = {s for s in open_ if left * sources[s].weight / weight >= caps[s]}
        if not full:
            for s in open_:
                out[s] = left * sources[s].weight / weight
            break
        for s in sorted(full):
            out[s] = caps[s]
            left -= caps[s]
        open_ -= full
    return out


def feasible_total(sources: Mapping[str, Share]) -> float:
    """The greatest total that meets every weight exactly: the least cap over weight of the sources that have tokens."""
    usable = [x for x in sources.values() if x.weight > 0 and x.tokens > 0 and x.max_repeats > 0]
    weight = sum(x.weight for x in usable)
    return min((x.tokens * x.max_repeats * weight / x.weight for x in usable), default=0.0)


def sized_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens), computed once: tokens are counted once per document and reused by every step.

    A document counts once, so that none is drawn more often than allowed: of rows that differ in source or length, the one with the least source (null
    last), then the fewest tokens. Rows are combined before the shuffle, which moves sizes only. Rows without doc_id are left out.
    """
    counted = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "source", token_count(F.col("text"), vocabulary, folder).alias("n_tokens"))
    least = F.min(F.struct(F.col("source").isNull().alias("without"), "source", "n_tokens")).alias("r")
    return cut(counted.groupBy("doc_id").agg(least).select("doc_id", "r.source", "r.n_tokens"))


def source_shares(sized: DataFrame, weights: DataFrame) -> dict[str, Share]:
    """Weight, tokens and cap of each weighted source. The driver gets one row per row of `weights`, a helper table of sources.

    Of several rows of a source the greatest values count; null sources, shares and repeats count as none.
    """
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    w = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m"))
    rows = w.join(per_source, "source", "left").collect()
    return {r["source"]: Share(max(r["w"] or 0.0, 0.0), r["tokens"] or 0, max(r["m"] or 0, 0)) for r in rows}


def _draw(seed: int) -> Column:
    """A 63-bit hash that orders the documents of a source for a seed."""
    return F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    total_tokens: float | None = None,
    seed: int = 42,
    vocabulary: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, repeats) and its report (source, target_share, max_repeats, available_tokens,
    planned_tokens, reached_tokens, reached_share), one row per weighted source.

    total_tokens defaults to the tokens of all documents of weighted sources. A source planned at e times its size
    gives each document floor(e) times, and once more those that come first in a seeded hash order until the rest is
    reached as closely as whole documents allow. Documents of sources without a weight, and ones without tokens, are not drawn.

    The cut of a source is found without gathering it anywhere: tokens per hash bin are summed in each task, the bin of the cut is located, then the same
    is done within that bin, and only the bin of a bin (a 2**24th of the source) is put in exact order.
    """
    sized = sized_documents(docs, vocabulary, folder)
    shares = source_shares(sized, weights)
    total = float(sum(x.tokens for x in shares.values() if x.weight > 0)) if total_tokens is None else float(total_tokens)
    plan = water_fill(shares, total)
    spark = docs.sparkSession
    rows = []
    for s, x in sorted(shares.items()):
        whole = int(plan[s] // x.tokens) if x.tokens else 0
        rows.append((s, x.weight, x.max_repeats, int(x.tokens), float(plan[s]), whole, float(plan[s] - whole * x.tokens)))
    schema = "source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double, whole int, rest double"
    plans = spark.createDataFrame(rows, schema)

    def per_source(df: DataFrame) -> DataFrame:
        """df has a row per weighted source at most."""
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    own = sized.where(F.col("n_tokens") > 0).join(per_source(plans.select("source", "whole", "rest")), "source")
    own = own.withColumn("h", _draw(seed))

    def times(df: DataFrame, more: int) -> DataFrame:
        return df.select("doc_id", "source", "n_tokens", (F.col("whole") + F.lit(more)).alias("repeats"))

    drawn = times(own.where("rest <= 0"), 0)
    edge = own.where("rest > 0").withColumn("before", F.lit(0).cast("bigint"))
    for step in range(STEPS):
        binned = edge.withColumn("bin", F.shiftright("h", 63 - BITS * (step + 1)).bitwiseAND(F.lit((1 << BITS) - 1)))
        earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over bins, not documents
        bins = binned.groupBy("source", "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        placed = bins.withColumn("upto", F.col("base") + F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)))
        crossed = (F.col("upto") < F.col("rest")) & (F.col("upto") + F.col("in_bin") >= F.col("rest"))
        cuts = cut(placed.where(crossed).select("source", F.col("bin").alias("cut_bin"), "upto"))
        at = binned.join(per_source(cuts), "source", "left")
        # A source that never reaches its rest has no cut: all of it is drawn once more.
        drawn = drawn.unionByName(times(at.where(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1)).unionByName(times(at.where(F.col("bin") > F.col("cut_bin")), 0))
        edge = at.where(F.col("bin") == F.col("cut_bin")).drop("before", "bin", "cut_bin").withColumnRenamed("upto", "before")
    in_order = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("so_far", F.col("before") + F.sum("n_tokens").over(in_order))
    drawn_edge = edge.select("doc_id", "source", "n_tokens", (F.col("whole") + F.when(F.col("so_far") - F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)).alias("repeats"))
    drawn = drawn.unionByName(drawn_edge)
    mixed = cut(drawn.where(F.col("repeats") > 0))
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"))
    all_reached = mixed.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("repeats")), F.lit(0)).alias("t")).scalar()
    r = F.coalesce("reached", F.lit(0).cast("bigint"))
    share = F.when(all_reached > 0, r / all_reached).otherwise(F.lit(0.0))
    planned = ("source", "target_share", "max_repeats", "available_tokens", "planned_tokens")
    report = plans.join(reached, "source", "left").select(*planned, r.alias("reached_tokens"), share.alias("reached_share"))
    return mixed, report
