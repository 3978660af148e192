"""From a query tree to one DataFrame plan over an index.

Postings of the query's terms are filtered at the scan, grouped once by document into a column per term, and
the tree becomes a single boolean Column over them. A second, set-based form exists for checking the first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.score import K1, B, idf_bm25, idf_tfidf, score_bm25, score_tfidf
from termloom.operators.index import Index
from termloom.plans.query import And, Leaf, Node, Not, Or, Phrase, Term, holds, leaves, scoring_leaves
from termloom.runtime import broadcast_up_to

#: Terms of joint queries up to which they are pushed to the scan.
PUSHED_TERMS = 1000
RANKERS = ("bm25", "tfidf")
_ALIASES = {"tfidf": "tfidf", "tf-idf": "tfidf", "tf_idf": "tfidf"}


def ranker_name(name: str) -> str:
    """Unknown names mean bm25."""
    return _ALIASES.get(name.lower(), "bm25")


@dataclass(frozen=True)
class _Slots:
    """Distinct leaves of a tree and the terms they need, by column number."""

    leaves: tuple[Leaf, ...]
    terms: tuple[str, ...]

    @classmethod
    def of(cls, *trees: Node) -> _Slots:
        own = tuple(dict.fromkeys(x for t in trees for x in leaves(t)))
        names = dict.fromkeys(t for x in own for t in ((x.value,) if isinstance(x, Term) else x.terms))
        return cls(own, tuple(t for t in names if t))

    @property
    def in_phrases(self) -> set[str]:
        return {t for x in self.leaves if isinstance(x, Phrase) for t in x.terms}


def _tf(slots: _Slots, leaf: Leaf) -> Column:
    """Occurrences of a leaf in a grouped row, never null."""
    if isinstance(leaf, Term):
        return F.coalesce(F.col(f"tf_{slots.terms.index(leaf.value)}"), F.lit(0)) if leaf.value else F.lit(0)
    return F.coalesce(F.size(_starts(slots, leaf)), F.lit(0))


def _starts(slots: _Slots, phrase: Phrase) -> Column:
    """Start positions of a phrase; null or empty where it doesn't occur."""
    first, *rest = (F.col(f"pos_{slots.terms.index(t)}") for t in phrase.terms)
    if not rest:
        return first

    def follows(s: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.coalesce(F.array_contains(p, s + F.lit(i)), F.lit(False)) for i, p in enumerate(rest, 1)))

    return F.filter(first, follows)


def _condition(node: Node, slots: _Slots) -> Column:
    match node:
        case Term() | Phrase():
            return F.col(f"n_{slots.leaves.index(node)}") > 0
        case Not(child):
            return ~_condition(child, slots)
        case And(left, right):
            return _condition(left, slots) & _condition(right, slots)
        case Or(left, right):
            return _condition(left, slots) | _condition(right, slots)


def leaf_counts(index: Index, slots: _Slots, keys: tuple[str, ...] = ("doc_id",), postings: DataFrame | None = None) -> DataFrame:
    """(keys, length, n_0, n_1, ...): length and occurrences of each leaf of every document that holds any of the terms. One shuffle, by document."""
    source = index.postings if postings is None else postings
    p = source.where(F.col("term").isin(*slots.terms)) if slots.terms else source.where(F.lit(False))
    picks = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(slots.terms)]
    picks += [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"pos_{i}") for i, t in enumerate(slots.terms) if t in slots.in_phrases]
    grouped = p.groupBy(*keys).agg(F.max("length").alias("length"), *picks)
    return grouped.select(*keys, "length", *(_tf(slots, x).cast("int").alias(f"n_{i}") for i, x in enumerate(slots.leaves)))


def matches(index: Index, node: Node) -> DataFrame:
    """(doc_id, length, n_i per leaf) of the documents that match; documents without any leaf take part only if the tree asks for it."""
    return _matched(index, node, _Slots.of(node), leaf_counts(index, _Slots.of(node)))


def _matched(index: Index, node: Node, slots: _Slots, counts: DataFrame) -> DataFrame:
    if not holds(node, set()):
        return counts.where(_condition(node, slots))
    every = index.docs.select("doc_id").join(counts, "doc_id", "left")
    # A document without any leaf has no length here and needs none: no leaf scores.
    filled = every.select("doc_id", "length", *(F.coalesce(f"n_{i}", F.lit(0)).alias(f"n_{i}") for i in range(len(slots.leaves))))
    return filled.where(_condition(node, slots))


def matches_by_sets(index: Index, node: Node) -> DataFrame:
    """(doc_id): the same by intersect, union and anti-join; phrases by a positional equi-join."""
    match node:
        case Term(value):
            return index.postings.where(F.col("term") == value).select("doc_id").distinct()
        case Phrase(words):
            found = None
            for i, w in enumerate(words):
                exploded = index.postings.where(F.col("term") == w).select("doc_id", F.explode("positions").alias("pos"))
                at = exploded.select("doc_id", (F.col("pos") - F.lit(i)).alias("start"))
                found = at if found is None else found.join(at, ["doc_id", "start"], "left_semi")
            return found.select("doc_id").distinct()
        case And(left, right):
            return matches_by_sets(index, left).intersect(matches_by_sets(index, right))
        case Or(left, right):
            return matches_by_sets(index, left).union(matches_by_sets(index, right)).distinct()
        case Not(child):
            return index.docs.select("doc_id").join(matches_by_sets(index, child), "doc_id", "left_anti")


def phrase_starts(index: Index, phrase: Phrase) -> DataFrame:
    """(doc_id, starts): ascending start positions of a phrase."""
    slots = _Slots.of(phrase)
    p = index.postings.where(F.col("term").isin(*slots.terms))
    wide = p.groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"pos_{i}") for i, t in enumerate(slots.terms)))
    return wide.select("doc_id", _starts(slots, phrase).alias("starts")).where(F.size("starts") > 0)


def weights(index: Index, slots: _Slots, counts: DataFrame, wanted: list[Leaf], ranker: str) -> Column:
    """(avgdl, idf of each wanted leaf) as one scalar, before any boolean filter.

    Frequencies of all terms come from one read of the statistics, those of all phrases from one pass over their documents; nothing is worked out again per row.
    """
    idf = idf_tfidf if ranker == "tfidf" else idf_bm25
    terms = list(dict.fromkeys(x.value for x in wanted if isinstance(x, Term)))
    phrases = list(dict.fromkeys(x for x in wanted if isinstance(x, Phrase)))
    known = F.map_from_entries(F.collect_list(F.struct("term", "df")))  # a row per term of the query
    collection = index.stats.select(F.struct("n_docs", "avgdl").alias("c")).scalar()
    row = index.terms.where(F.col("term").isin(*terms) if terms else F.lit(False)).agg(known.alias("df")).withColumn("c", collection)
    if phrases:
        sums = [F.coalesce(F.sum((F.col(f"n_{slots.leaves.index(x)}") > 0).cast("bigint")), F.lit(0)) for x in phrases]
        row = row.withColumn("held", counts.agg(F.array(*sums).alias("held")).scalar())

    def df(leaf: Leaf) -> Column:
        if isinstance(leaf, Term):
            return F.coalesce(F.try_element_at("df", F.lit(leaf.value)), F.lit(0))
        return F.get("held", F.lit(phrases.index(leaf)))

    return row.select(F.struct(F.col("c.avgdl").alias("avgdl"), F.array(*(idf(F.col("c.n_docs"), df(x)) for x in wanted)).alias("idf")).alias("w")).scalar()


def collection(index: Index) -> tuple[Column, Column]:
    """Number of documents and average length, as parts of one scalar."""
    row = index.stats.select(F.struct("n_docs", "avgdl").alias("s")).scalar()
    return row["n_docs"], row["avgdl"]


def scored(index: Index, node: Node, ranker: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of every match; the score is a sum over the scoring leaves in their order."""
    slots = _Slots.of(node)
    counts = leaf_counts(index, slots)
    hits = _matched(index, node, slots, counts)
    parts = [x for x in scoring_leaves(node) if not (isinstance(x, Term) and not x.value)]
    if not parts:
        return hits.select("doc_id", F.lit(0.0).alias("score"))
    wanted, ranker = list(dict.fromkeys(parts)), ranker_name(ranker)
    hits = hits.withColumn("w", weights(index, slots, counts, wanted, ranker))

    def part(leaf: Leaf) -> Column:
        n, idf = F.col(f"n_{slots.leaves.index(leaf)}"), F.get("w.idf", F.lit(wanted.index(leaf)))
        return score_tfidf(n, idf) if ranker == "tfidf" else score_bm25(n, idf, F.col("length"), F.col("w.avgdl"), k1, b)

    return hits.select("doc_id", reduce(lambda x, y: x + y, map(part, parts)).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(rank, doc_id, score): the k best, ties by doc_id. digits rounds scores before they are ordered."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    best = scores.select("doc_id", s.alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), F.asc("doc_id"))).alias("rank"), "doc_id", "score")


def _shape(node: Node, slots: _Slots) -> object:
    """A tree with its leaves replaced by the numbers of their terms: queries of one shape differ in words only."""
    match node:
        case Term(value):
            return slots.terms.index(value) if value else None
        case Phrase(words):
            return ("phrase", *(slots.terms.index(t) if t else None for t in words))
        case Not(child):
            return ("not", _shape(child, slots))
        case And(left, right):
            return ("and", _shape(left, slots), _shape(right, slots))
        case Or(left, right):
            return ("or", _shape(left, slots), _shape(right, slots))


class _Joint:
    """Several queries evaluated over shared columns: slot i of a query's terms is column i of its own rows.

    The queries are rows; expressions are written once per shape of a tree, so their number doesn't grow with that of the queries.
    """

    def __init__(self, trees: dict[str, Node]):
        self.slots = {q: _Slots.of(t) for q, t in trees.items()}
        shapes: dict[object, int] = {}
        self.shape = {q: shapes.setdefault(_shape(t, self.slots[q]), len(shapes)) for q, t in trees.items()}
        first: dict[int, str] = {}
        for q, i in self.shape.items():
            first.setdefault(i, q)
        self.models = [(trees[q], self.slots[q]) for q in first.values()]

    def case(self, value: Callable[[Node, _Slots], Column | None]) -> Column:
        """The value of each row's own shape; null for shapes without one."""
        out: Column | None = None
        for i, model in enumerate(self.models):
            own = value(*model)
            if own is not None:
                here = F.col("shape") == i
                out = F.when(here, own) if out is None else out.when(here, own)
        return F.lit(None) if out is None else out

    def leaf_counts(self, index: Index) -> DataFrame:
        """(query, shape, doc_id, length, n_0, n_1, ...): occurrences of the query's own leaves."""
        rows = [(q, self.shape[q], t, i) for q, s in self.slots.items() for i, t in enumerate(s.terms)]
        wanted = index.docs.sparkSession.createDataFrame(rows, "query string, shape int, term string, slot int")
        positions = any(s.in_phrases for _, s in self.models)
        found = F.struct("slot", F.struct(*(["tf", "positions"] if positions else ["tf"])).alias("v"))
        terms = {t for _, _, t, _ in rows}
        # The join finds the rows; naming the terms besides, while they are few, lets the scan skip files and row groups.
        postings = index.postings.where(F.col("term").isin(*sorted(terms))) if len(terms) <= PUSHED_TERMS else index.postings
        hits = postings.join(broadcast_up_to(wanted, len(rows)), "term")
        # A row per query and document; its list holds a row per term of the query.
        per_doc = hits.groupBy("query", "shape", "doc_id").agg(F.max("length").alias("length"), F.map_from_entries(F.collect_list(found)).alias("m"))
        columns = []
        for i in range(max(len(s.terms) for _, s in self.models)):
            entry = F.try_element_at("m", F.lit(i))
            columns.append(entry["tf"].alias(f"tf_{i}"))
            if positions:
                columns.append(entry["positions"].alias(f"pos_{i}"))
        wide = per_doc.select("query", "shape", "doc_id", "length", *columns)
        counts = []
        for i in range(self.most_leaves):
            n = self.case(lambda _, s, i=i: _tf(s, s.leaves[i]) if i < len(s.leaves) else None)
            counts.append(F.coalesce(n.cast("int"), F.lit(0)).alias(f"n_{i}"))
        return wide.select("query", "shape", "doc_id", "length", *counts)

    @property
    def most_leaves(self) -> int:
        return max(len(s.leaves) for _, s in self.models)

    def scored(self, index: Index, ranker: str, k1: float, b: float) -> DataFrame:
        """(query, doc_id, score) of every match of every query."""
        counts = self.leaf_counts(index)
        dfs = counts.groupBy("query").agg(*(F.sum((F.col(f"n_{i}") > 0).cast("bigint")).alias(f"df_{i}") for i in range(self.most_leaves)))
        hits = counts.join(broadcast_up_to(dfs, len(self.slots)), "query").where(F.coalesce(self.case(_condition), F.lit(False)))  # dfs: one row per query
        n, avgdl = collection(index)
        bm25 = ranker_name(ranker) == "bm25"

        def part(i: int) -> Column:
            if bm25:
                return score_bm25(F.col(f"n_{i}"), idf_bm25(n, F.col(f"df_{i}")), F.col("length"), avgdl, k1, b)
            return score_tfidf(F.col(f"n_{i}"), idf_tfidf(n, F.col(f"df_{i}")))

        def total(tree: Node, slots: _Slots) -> Column:
            parts = [x for x in scoring_leaves(tree) if not (isinstance(x, Term) and not x.value)]
            return reduce(lambda x, y: x + y, (part(slots.leaves.index(x)) for x in parts), F.lit(0.0))

        return hits.select("query", "doc_id", self.case(total).alias("score"))


def search_many(
    index: Index, queries: dict[str, Node], k: int, ranker: str = "bm25", k1: float = K1, b: float = B, digits: int | None = None
) -> DataFrame:
    """(query, rank, doc_id, score) of many queries in one plan: postings are read once for all of them.

    The queries' terms are a table joined to the postings; the condition and score of each query's shape apply to its
    rows. Queries that match documents without any leaf are run by themselves and united.
    """
    joint = {q: node for q, node in queries.items() if not holds(node, set()) and _Slots.of(node).terms}
    results: list[DataFrame] = []
    if joint:
        scores = _Joint(joint).scored(index, ranker, k1, b)
        best = scores if digits is None else scores.withColumn("score", F.round("score", digits))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(ranked.select("query", "rank", "doc_id", "score"))
    for q, node in queries.items():
        if holds(node, set()):
            best = top_k(scored(index, node, ranker, k1, b), k, digits)
            results.append(best.select(F.lit(q).alias("query"), "rank", "doc_id", "score"))
    if not results:
        none = index.docs.where(F.lit(False))
        return none.select(F.lit("").alias("query"), F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score"))
    return reduce(lambda x, y: x.unionByName(y), results)
