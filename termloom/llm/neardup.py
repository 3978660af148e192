"""Near-duplicate records: weighted MinHash signatures, banding, exact verification.

Signatures follow ProbMinHash: every element of a record's weighted set emits a Poisson process of arrivals
whose rate is its weight; each arrival falls into one of m slots at random, and a slot keeps the element that came
first. Two records agree in a slot with their probability Jaccard similarity, which for unit weights is the
Jaccard similarity of their sets, independently over slots. An element stops as soon as its next arrival is later than the
latest slot of its record, so the work per record is about m ln m arrivals in all, not m per element.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.analyze import LOWER, UPPER, tokens
from termloom.runtime import written

#: Scripts written without spaces, each character of which is a word; the marks and the space used with them, which are none; blanks.
UNSPACED = "".join(
    rf"\p{{Is{s}}}" for s in "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Javanese Balinese Tai_Le New_Tai_Lue Tai_Tham Tai_Viet".split()
) + r"\x{30FC}\x{FF70}"
_CJK_MARKS = r"\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{303D}\x{30FB}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"
_WORD = rf"[{UNSPACED}]\p{{M}}*|[A-Za-z0-9\x{{80}}-\x{{10FFFF}}&&[^{UNSPACED}{_CJK_MARKS}]]+"
#: All of these scripts and marks lie here; a text without any such character is split as the project's tokens are, by a plainer pattern.
_FAR = r"[\x{0E00}-\x{10FFFF}]"
_NOT_BLANK = r"[^\s\x{85}\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64, the random source of the arrivals."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, record: np.ndarray, n_records: int, m: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n_records, m) signatures: the element that arrives first in each slot, 0 for records without elements.

    elements: uint64 element hashes; record: the record number of each, 0..n_records-1; weights: positive, default 1. An
    element's arrivals depend on its hash alone, so equal elements of different records race alike.
    """
    first = np.full(n_records * m, np.inf)
    owner = np.zeros(n_records * m, dtype=np.uint64)
    alive = np.arange(len(elements))
    state = _mix(elements + _GOLD)
    rate = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=float)
    at = np.zeros(len(elements))
    last = np.full(n_records, np.inf)
    turn = 0
    with np.errstate(over="ignore"):
        while len(alive):
            turn += 1
            state = _mix(state + _GOLD * np.uint64(turn))
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
            slot = record[alive] * m + (_mix(state + _GOLD) % np.uint64(m)).astype(np.int64)
            sooner = at < first[slot]
            s, t, e = slot[sooner], at[sooner], elements[alive[sooner]]
            order = np.argsort(t)[::-1]  # the soonest of several in one slot is written last
            first[s[order]], owner[s[order]] = t[order], e[order]
            if turn % 8 == 0:
                last = first.reshape(n_records, m).max(axis=1)
            on = at < last[record[alive]]
            alive, at, state, rate = alive[on], at[on], state[on], rate[on]
    return owner.reshape(n_records, m)


def folded_tokens(text: Column) -> Column:
    """The tokens of a text in ASCII lower case."""
    return tokens(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The tokens of a text in ASCII lower case, scripts without spaces split into characters; none for null and blank texts."""
    fine = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(_WORD), F.lit(0))
    words = F.when(text.rlike(_FAR), fine).otherwise(folded_tokens(text))
    return F.when(text.rlike(_NOT_BLANK), words).otherwise(F.array().cast("array<string>"))


def word_shingles(words_col: str, words: int, short: bool = False) -> Column:
    """Distinct hashes of all runs of `words` consecutive entries of an array column; empty where there are fewer.

    short: fewer, but at least one, are one run (a hash passes over the nulls beyond the end).

    Takes a column, not an expression: inside the lambda an expression would be worked out again for every run.
    """
    t = F.col(words_col)
    starts = F.slice(t, F.lit(1), F.greatest(F.size(t) - F.lit(words - 1), F.least(F.size(t), F.lit(1)) if short else F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(t, i + F.lit(k)) for k in range(1, words)))))


def bands_for(threshold: float, rows: int, missed: float = 2e-6) -> int:
    """How many bands of `rows` slots leave a pair right at the threshold without a common band with probability `missed` at most."""
    return math.ceil(math.log(missed) / math.log1p(-min(threshold**rows, 1 - 1e-9)))


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, h1, n): one row per band of each class; key joins the band's number and its slots."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                h1, n, sets = whole.slice(start, 512).columns
                sizes = n.to_numpy()
                # Sets ascend in signed order; seen as unsigned they are the same set.
                flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sig = signatures(flat, np.repeat(np.arange(len(sizes)), sizes), len(sizes), bands * rows)
                key = np.zeros((len(sizes), bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = _mix(key + _GOLD + sig.reshape(len(sizes), bands, rows)[:, :, r])
                    key = _mix(key + np.arange(bands, dtype=np.uint64) * _GOLD)
                columns = [key.view(np.int64).ravel(), np.repeat(h1.to_numpy(), bands), np.repeat(sizes, bands)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "h1", "n"])

    return classes.select("h1", "n", "shingles").mapInArrow(keyed, "key bigint, h1 bigint, n int")


#: A class: two independent 64-bit hashes of its set. Bands carry the first only; what it confuses, verification tells apart.
CLASS = ["h1", "h2"]


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, words: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """members (h1, h2, id) and classes (h1, h2, class_id, copies, n, shingles): records with the same shingle set share a class.

    class_id is the least id of the class. Records without shingles or without an id are left out.
    every: no record is left out. Words are those of split_words, fewer than `words` are one shingle; records without words share
    the class of the empty set. Both are written in the shared folder by columns: who reads the members doesn't read the sets.
    """
    if every:
        sets = docs.select(F.col(id_col).alias("id"), split_words(F.col(text_col)).alias("_words"))
    else:
        split = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), folded_tokens(F.col(text_col)).alias("_words"))
        # The filter is on the tokens: one on the shingles would be pushed below them and take the tokenizer into the lambda.
        sets = split.where(F.size("_words") >= words)
    sets = sets.select("id", F.sort_array(word_shingles("_words", words, every)).alias("shingles"))
    own = written(sets.select(F.xxhash64("shingles", F.size("shingles")).alias("h1"), F.xxhash64(F.lit(words), "shingles").alias("h2"), "id", "shingles"), "sets")
    same = own.groupBy(*CLASS).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"))
    return own.select(*CLASS, "id"), written(same.select(*CLASS, "class_id", "copies", F.size("shingles").alias("n"), "shingles"), "classes")


def _ends(df: DataFrame, end: str, *columns: str) -> DataFrame:
    """df with the columns h1 and h2 (and others) named for one end of a pair."""
    return df.select(*(F.col(c).alias(f"{c}{end}") for c in (*CLASS, *columns)))


def similar_classes(classes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """(h1a, h2a, h1b, h2b, similarity), h1a < h1b: all class pairs whose Jaccard similarity reaches the threshold.

    Bands are joined by key, an equi-join whose hot keys AQE splits; a key is hot only if its classes agree in
    `rows` slots. Pairs whose sizes rule the threshold out are dropped in the join, every other candidate is
    verified on the sets themselves. All sides grow with the data, so each join is a merge join, whatever the planner's estimate of an
    array column; no set passes through the driver.
    """
    bucket = band_keys(classes.where("n > 0"), bands_for(threshold, rows), rows)
    a, b = bucket.alias("a"), bucket.hint("merge").alias("b")
    fits = (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h1") < F.col("b.h1")) & fits)
    candidates = pairs.select(F.col("a.h1").alias("h1a"), F.col("b.h1").alias("h1b")).distinct()
    left, right = _ends(classes, "a", "shingles"), _ends(classes, "b", "shingles")
    common = F.size(F.array_intersect("shinglesa", "shinglesb"))
    both = candidates.join(left.hint("merge"), "h1a").join(right.hint("merge"), "h1b")
    measured = both.select("h1a", "h2a", "h1b", "h2b", common.alias("k"), (F.size("shinglesa") + F.size("shinglesb")).alias("t"))
    return measured.select("h1a", "h2a", "h1b", "h2b", (F.col("k") / (F.col("t") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, rows: int = 4) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every pair of records whose shingle sets reach the threshold.

    A pair right at the threshold is missed with probability 2e-6 (see bands_for), one above it with less. Null, empty and
    short texts (fewer tokens than `words`) are in no pair; repeated ids with one text count once; other columns are
    ignored. Copies share a class and are expanded at the end only.
    """
    members, classes = shingle_classes(docs, id_col, text_col, words)
    links = written(similar_classes(classes, threshold, rows), "links")
    across = links.join(_ends(members, "a", "id").hint("merge"), ["h1a", "h2a"]).join(_ends(members, "b", "id").hint("merge"), ["h1b", "h2b"]).where("ida != idb")
    linked = across.select(F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"), "similarity")
    several = members.join(classes.where("copies > 1").select(*CLASS).hint("merge"), CLASS, "left_semi")
    m, k = several.alias("m"), several.hint("merge").alias("k")
    within = m.join(k, (F.col("m.h1") == F.col("k.h1")) & (F.col("m.h2") == F.col("k.h2")) & (F.col("m.id") < F.col("k.id")))
    return linked.unionByName(within.select(F.col("m.id").alias("id_a"), F.col("k.id").alias("id_b"), F.lit(1.0).alias("similarity"))).distinct()


def near_duplicate_links(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, rows: int = 4, every: bool = False) -> DataFrame:
    """(id, class_id, copies, links): one row per record with shingles, or per record (every, see shingle_classes).

    class_id is the least id of those with the same set, copies their number, links the number of other classes that reach the threshold with it.
    """
    members, classes = shingle_classes(docs, id_col, text_col, words, every)
    links = written(similar_classes(classes, threshold, rows), "links")
    ends = links.select(F.explode(F.array(F.struct(F.col("h1a").alias("h1"), F.col("h2a").alias("h2")), F.struct(F.col("h1b").alias("h1"), F.col("h2b").alias("h2")))).alias("e"))
    counted = ends.groupBy("e.h1", "e.h2").agg(F.count("*").alias("links"))
    per_class = classes.select(*CLASS, "class_id", "copies").join(counted.hint("merge"), CLASS, "left")
    return members.join(per_class.hint("merge"), CLASS).select("id", "class_id", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
