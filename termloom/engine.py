"""The engine: index a directory or a table, search, look up, persist."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.cache import ResponseCache
from termloom.config import Config
from termloom.files import Files
from termloom.functions.analyze import STOP_WORDS
from termloom.functions.snippet import snippet_column
from termloom.operators.index import Delta, Index, build_index, delta_of, index_diff, size_estimate, with_statistics
from termloom.plans.compile import ranker_name, scored, search_many, top_k
from termloom.plans.query import parse_query
from termloom.runtime import cut, scratch_path
from termloom.sources.directory import as_corpus, scan_directory
from termloom.sources.tables import corpus_from_table
from termloom.store import IndexLoadError, current_version, load_index, save_index, update_index

#: Unreadable files that a report shows by itself; error_rows has them all.
SHOWN_ERRORS = 1000

_EMPTY_DOCS = "doc_id {id}, path string, title string, token_count int, modified_time bigint, content string"
_EMPTY_POSTINGS = "term string, doc_id {id}, tf int, positions array<int>, length int"


@dataclass(frozen=True)
class SearchResult:
    document_id: object
    title: str
    path: str
    score: float
    snippet: str


@dataclass(frozen=True)
class SearchResponse:
    query: str
    ranker: str
    total_candidates: int
    duration_ms: float
    cache_hit: bool
    results: tuple[SearchResult, ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


@dataclass(frozen=True)
class IndexReport:
    """found = added + updated + unchanged + errors. error_rows: (doc_id, path, error) of all unreadable files, error_details the first by path."""

    found: int = 0
    added: int = 0
    updated: int = 0
    deleted: int = 0
    unchanged: int = 0
    errors: int = 0
    error_details: tuple[tuple[str, str], ...] = field(default=())
    duration_ms: float = 0.0
    error_rows: DataFrame | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class EngineStats:
    documents: int
    terms: int
    total_tokens: int
    average_document_length: float
    index_size_bytes: int
    cache_hits: int
    cache_misses: int

    @property
    def hit_rate(self) -> float:
        asked = self.cache_hits + self.cache_misses
        return self.cache_hits / asked if asked else 0.0


class Engine:
    """One index and its cache. Each indexing run writes a new snapshot aside and switches to it, so searches under way keep theirs."""

    def __init__(self, spark: SparkSession, config: Config = Config(), stop_words: tuple[str, ...] = STOP_WORDS, id_type: str = "string"):
        self.spark, self.config, self.stop_words = spark, config, stop_words
        self.cache = ResponseCache(config.cache_capacity)
        self.index = with_statistics(spark.createDataFrame([], _EMPTY_DOCS.format(id=id_type)), spark.createDataFrame([], _EMPTY_POSTINGS.format(id=id_type)))
        self.version = "empty"

    # --- indexing ---------------------------------------------------------------------------------

    def index_directory(self, root: str, incremental: bool = True) -> IndexReport:
        """Makes the index mirror a directory: files that aren't in it any more leave the index, only new and changed ones are read and
        analyzed. Raises FileNotFoundError for a root that isn't a directory."""
        began = time.perf_counter()
        if not incremental or self.version == "empty":
            with self._read_once(as_corpus(scan_directory(self.spark, root))) as scan:
                ok = scan.where(F.col("error").isNull())
                found = scan.count()
                bad = self._errors(scan)
                errors = bad.count()
                self._switch(build_index(ok, self.stop_words))
            return IndexReport(found=found, added=found - errors, errors=errors, error_details=self._excerpt(bad), duration_ms=_ms(began), error_rows=bad)
        listed = scan_directory(self.spark, root, with_content=False)
        diff = index_diff(listed, self.index.docs).cache()
        try:
            counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
            if counts.keys() & {"added", "updated"}:
                scan = scan_directory(self.spark, root, diff.where(F.col("change").isin("added", "updated")))
            else:  # nothing to read
                scan = listed.where(F.lit(False)).withColumns({"raw": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")})
            with self._read_once(as_corpus(scan)) as corpus:
                bad = self._errors(corpus)
                failed = {r["change"]: r["count"] for r in diff.join(bad, "doc_id", "left_semi").groupBy("change").count().collect()}
                if counts.keys() - {"unchanged"}:
                    self.update(delta_of(diff.join(bad.select("doc_id"), "doc_id", "left_anti"), corpus.where(F.col("error").isNull())))
        finally:
            diff.unpersist()
        n = {k: counts.get(k, 0) - failed.get(k, 0) for k in ("added", "updated", "deleted", "unchanged")}
        errors = sum(failed.values())
        found = n["added"] + n["updated"] + n["unchanged"] + errors
        return IndexReport(found=found, errors=errors, error_details=self._excerpt(bad), duration_ms=_ms(began), error_rows=bad, **n)

    def index_table(self, df: DataFrame, id_col: str, text_col: str, path_col: str | None = None, modified_col: str | None = None) -> IndexReport:
        """Builds the index over a table instead; it replaces what was indexed."""
        began = time.perf_counter()
        corpus = corpus_from_table(df, id_col, text_col, path_col, modified_col)
        self._switch(build_index(corpus, self.stop_words))
        n = self.index.stats.first()["n_docs"]
        return IndexReport(found=n, added=n, duration_ms=_ms(began))

    @contextmanager
    def _read_once(self, corpus: DataFrame) -> Iterator[DataFrame]:
        """The corpus as a table in the shared folder while it is indexed: its files are opened once, whatever is made of them."""
        path = scratch_path(self.spark, "corpus")
        corpus.write.parquet(path)
        try:
            yield self.spark.read.schema(corpus.schema).parquet(path)
        finally:
            Files(self.spark).delete(path)

    @staticmethod
    def _errors(corpus: DataFrame) -> DataFrame:
        """(doc_id, path, error) of all files that couldn't be read, written once so that count, list and index agree."""
        return cut(corpus.where(F.col("error").isNotNull()).select("doc_id", "path", "error"))

    @staticmethod
    def _excerpt(bad: DataFrame) -> tuple[tuple[str, str], ...]:
        return tuple((r["path"], r["error"]) for r in bad.orderBy("path").limit(SHOWN_ERRORS).collect())

    def update(self, change: Delta) -> None:
        """Applies a change to the snapshot at config.index_path, writing what changes only."""
        if self.version == "empty":
            save_index(self.index, self.config.index_path)
        update_index(self.spark, self.config.index_path, change, self.stop_words)
        self.load()

    def _switch(self, index: Index) -> None:
        save_index(index, self.config.index_path)
        self.load()

    def save(self, path: str | None = None) -> str:
        """Writes the index to a path of its own; indexing has saved it at config.index_path already."""
        return save_index(self.index, path or self.config.index_path)

    def load(self, path: str | None = None) -> None:
        """Switches to the snapshot at a path. Raises IndexLoadError."""
        at = path or self.config.index_path
        self.index, self.version = load_index(self.spark, at), f"{at}/{current_version(self.spark, at)}"
        self.cache.invalidate_all()

    def load_if_present(self) -> bool:
        """Loads what is at config.index_path; a snapshot that can't be read leaves the engine empty."""
        try:
            self.load()
            return True
        except IndexLoadError:
            return False

    # --- search -----------------------------------------------------------------------------------

    def clamp(self, top: int | None) -> int:
        k = min(self.config.default_top_k if top is None else top, self.config.max_top_k)
        return k if k > 0 else self.config.default_top_k

    def search(self, query: str, top: int | None = None, ranker: str | None = None) -> SearchResponse:
        """The best matches. Raises QueryParseError; an answer is kept per snapshot, ranker, size and text of the query."""
        began = time.perf_counter()
        k, by = self.clamp(top), ranker_name(ranker or self.config.default_ranker)
        key = (self.version, by, k, query)
        known = self.cache.get(key)
        if known is not None:
            return SearchResponse(query, by, known.total_candidates, _ms(began), True, known.results)
        node = parse_query(query, self.stop_words)
        counted = Observation()
        hits = scored(self.index, node, by, self.config.k1, self.config.b).observe(counted, F.count(F.lit(1)).alias("n"))
        best = top_k(hits, k).collect()  # at most k rows; the matches are counted on the way
        total = counted.get.get("n", 0) if best else 0
        shown = self._shown([r["doc_id"] for r in best], query)
        results = tuple(SearchResult(r["doc_id"], *shown[r["doc_id"]][:2], r["score"], shown[r["doc_id"]][2]) for r in best)
        response = SearchResponse(query, by, total, _ms(began), False, results)
        self.cache.put(key, response)
        return response

    def _shown(self, ids: list, query: str) -> dict:
        """Title, path and snippet of a few documents; their ids are a pushed filter of the read."""
        if not ids:
            return {}
        text = snippet_column(F.col("content"), query, self.config.snippet_context_chars)
        rows = self.index.docs.where(F.col("doc_id").isin(ids)).select("doc_id", "title", "path", text.alias("snippet")).collect()
        return {r["doc_id"]: (r["title"], r["path"], r["snippet"]) for r in rows}

    def results(self, query: str, top: int | None = None, ranker: str | None = None) -> DataFrame:
        """(rank, doc_id, title, path, score, snippet): the same as a DataFrame, nothing collected."""
        c = self.config
        best = top_k(scored(self.index, parse_query(query, self.stop_words), ranker or c.default_ranker, c.k1, c.b), self.clamp(top))
        rows = self.index.docs.join(F.broadcast(best), "doc_id")  # at most max_top_k rows
        text = snippet_column(F.col("content"), query, c.snippet_context_chars)
        return rows.select("rank", "doc_id", "title", "path", "score", text.alias("snippet")).orderBy("rank")

    def search_many(self, queries: Mapping[str, str], top: int | None = None, ranker: str | None = None) -> DataFrame:
        """(query, rank, doc_id, score) for named queries, as one plan."""
        trees = {name: parse_query(q, self.stop_words) for name, q in queries.items()}
        return search_many(self.index, trees, self.clamp(top), ranker or self.config.default_ranker, self.config.k1, self.config.b)

    # --- lookups ----------------------------------------------------------------------------------

    def get_document(self, doc_id: object) -> dict | None:
        row = self.index.docs.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "title", "path", "token_count", "modified_time").first()
        return row.asDict() if row else None

    def postings_for(self, term: str) -> DataFrame:
        return self.index.postings.where(F.col("term") == term)

    def contains(self, doc_id: object) -> bool:
        return self.get_document(doc_id) is not None

    def document_ids(self) -> DataFrame:
        return self.index.docs.select("doc_id")

    def stats(self) -> EngineStats:
        r = size_estimate(self.index).first()
        return EngineStats(**r.asDict(), cache_hits=self.cache.hits, cache_misses=self.cache.misses)


def _ms(began: float) -> float:
    return (time.perf_counter() - began) * 1000
