"""References to records that don't exist: Bloom filter first, exact join for what passes it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.runtime import cut

#: Most 64-bit words of a filter (8 MB); above the keys this serves well, it passes more references on and stays right.
MAX_WORDS = 1 << 20


def _bit(key: Column, k: int, words: int) -> tuple[Column, Column]:
    """Word and mask of the k-th probe of a key, by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(k)) if k else F.lit(None)
    h = a if not k else b
    return F.pmod(F.shiftright(h, 6), F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))


def filter_words(keys: int, bits_per_key: int = 10) -> int:
    """Size of a filter in 64-bit words: a power of two, at least one, at most MAX_WORDS."""
    return min(MAX_WORDS, 1 << max(0, math.ceil(math.log2(max(1, keys * bits_per_key / 64)))))


def bloom_filter(keys: DataFrame, column: str, words: int, probes: int = 4) -> DataFrame:
    """One row: `bits`, the filter of the column as an array of 64-bit words.

    Each task folds its keys into words before the shuffle, so at most `words` rows per task move; the array
    is bounded by MAX_WORDS whatever the keys.
    """
    both = F.explode(F.array(*(F.struct(w.alias("w"), m.alias("m")) for w, m in (_bit(F.col(column), k, words) for k in range(probes)))))
    set_words = keys.where(F.col(column).isNotNull()).select(both.alias("b")).groupBy("b.w").agg(F.bit_or("b.m").alias("m"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("m"))
    filled = set_words.unionByName(every).groupBy("w").agg(F.bit_or("m").alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct("w", "m")))
    return filled.agg(F.transform(in_order, lambda x: x["m"]).alias("bits"))


def might_contain(bits: Column, key: Column, words: int, probes: int = 4) -> Column:
    """False proves that the key is in no parent row."""
    hits = [F.get(bits, w.cast("int")).bitwiseAND(m) != 0 for w, m in (_bit(key, k, words) for k in range(probes))]
    out = hits[0]
    for h in hits[1:]:
        out = out & h
    return out


def ref_key(entry: Column, root: str = "corpus/") -> Column:
    """The key an entry names: 16 hex digits are an id, anything else a path below the root, where a leading
    `./` and then the root itself are optional."""
    path = F.regexp_replace(entry, r"^\./", "")
    return F.when(entry.rlike("^[0-9a-fA-F]{16}$"), F.lower(entry)).otherwise(F.when(path.startswith(root), path).otherwise(F.concat(F.lit(root), path)))


def parent_keys(current: DataFrame, former: DataFrame) -> DataFrame:
    """(key, indexed_at, is_current), one row per id or path of either table; null keys are left out."""

    def keys(df: DataFrame, since: Column, is_current: bool) -> DataFrame:
        return df.select(F.explode(F.array("id", "path")).alias("key"), since.alias("indexed_at"), F.lit(is_current).alias("is_current"))

    both = keys(current, F.col("indexed_at"), True).unionByName(keys(former, F.lit(None).cast("timestamp_ntz"), False))
    return both.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("indexed_at").alias("indexed_at"), F.max("is_current").alias("is_current"))


def orphan_references(refs: DataFrame, current: DataFrame, former: DataFrame, root: str = "corpus/") -> DataFrame:
    """(eval_id, ref, kind, period): entries of refs.relevant that name no current document.

    refs: eval_id, relevant array<string>, labeled_at; current: id, path, indexed_at; former: id, path. kind is
    `missing` (in neither table), `deleted` (only in former) or `late` (in current, indexed after labeled_at;
    where either time is null that can't be said and the entry is none). period is yyyy-MM of labeled_at, null
    for null. Null and empty entries, null and empty lists don't count; repeated ones come out once.

    The filter of all parent keys goes to the tasks as one scalar of bounded size. What it refuses is `missing` for sure
    and takes no part in the join; the rest joins the parents by key, where a hot key is left to AQE's
    split of skewed partitions (the parent side has one row per key).
    """
    parents = parent_keys(current.select("id", "path", "indexed_at"), former.select("id", "path"))
    n = 2 * (current.count() + former.count())
    words = filter_words(n)
    entries = (
        refs.select("eval_id", "labeled_at", F.explode("relevant").alias("ref"))
        .where(F.col("ref") != "")
        .distinct()
        .withColumn("key", ref_key(F.col("ref"), root))
    )
    known = current.select(F.explode(F.array("id", "path")).alias("key")).unionByName(former.select(F.explode(F.array("id", "path")).alias("key")))
    bits = cut(bloom_filter(known, "key", words))
    probed = entries.withColumn("maybe", F.coalesce(might_contain(bits.scalar(), F.col("key"), words), F.lit(False)))
    period = F.date_format("labeled_at", "yyyy-MM")
    sure = probed.where(~F.col("maybe")).select("eval_id", "ref", F.lit("missing").alias("kind"), period.alias("period"))
    kind = (
        F.when(F.col("is_current").isNull(), "missing")
        .when(~F.col("is_current"), "deleted")
        .when(F.col("indexed_at") > F.col("labeled_at"), "late")
    )
    checked = (
        probed.where("maybe").join(parents, "key", "left").select("eval_id", "ref", kind.alias("kind"), period.alias("period")).where(F.col("kind").isNotNull())
    )
    return sure.unionByName(checked).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(kind, period, n): orphans per kind and month."""
    return orphans.groupBy("kind", "period").agg(F.count("*").alias("n"))
