"""Registered queries of what surrounds the index: files, lookups, the parser, the cache, adapters, streams, evaluation; with the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.cache import ResponseCache
from termloom.catalog import _BASE, _STOPS, BOOLEAN, DIGITS, RANKED, _phrase_sql, _ranked_sql, corpus, prepared
from termloom.config import Config, load_config
from termloom.engine import Engine
from termloom.evaluate import percentile
from termloom.files import Files
from termloom.functions.analyze import explode_terms, kept_tokens
from termloom.functions.ids import path_id
from termloom.functions.snippet import snippet_column
from termloom.http import respond
from termloom.operators.index import build_index, index_diff
from termloom.plans.compile import matches_by_sets
from termloom.plans.query import And, Node, Not, Or, Phrase, QueryParseError, Term, parse_query
from termloom.runtime import scratch_path, table
from termloom.sources.directory import as_corpus, is_local, scan_directory, write_files
from termloom.sources.evalset import read_evaluation
from termloom.sources.synthetic import synthetic_corpus
from termloom.store import IndexLoadError, load_index, save_index
from termloom.streaming.ingest import upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str) -> Callable:
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], SQL[name] = f, sql
        return f

    return take


def _values(columns: str, rows: Iterable[tuple]) -> str:
    """Expected rows written out in SQL."""
    def literal(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


def engine_of(s: SparkSession, d: str) -> Engine:
    """An engine over a snapshot of its own of the documents."""
    engine = Engine(s, Config(index_path=scratch_path(s, "engine")), id_type="bigint")
    save_index(prepared(s, d), engine.config.index_path)
    engine.load()
    return engine


# --- sources and store ------------------------------------------------------------------------------


def _folder_of_documents(s: SparkSession, d: str) -> str:
    """All documents as text files, one each, written by the tasks that hold them."""
    root = scratch_path(s, "files")
    rows = table(s, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if is_local(root):
        write_files(rows.select(F.concat(F.lit("doc_id="), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary")), root)
    else:
        rows.repartition("doc_id").write.partitionBy("doc_id").text(root)
    return root


def _file_id() -> F.Column:
    return F.regexp_extract("path", r"doc_id=(-?\d+)[/.]", 1).cast("bigint").alias("doc_id")


@_register("directory_scan", _BASE + "SELECT doc_id, token_count FROM lens")
def directory_scan(s: SparkSession, d: str) -> DataFrame:
    files = as_corpus(scan_directory(s, _folder_of_documents(s, d)))
    return files.where(F.col("error").isNull()).select(_file_id(), F.size(kept_tokens(F.col("content"))).alias("token_count"))


@_register("directory_reindex", "SELECT 'first' AS run, count(*) AS found, count(*) AS added, 0 AS unchanged, 0 AS errors FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'second', count(*), 0, count(*), 0 FROM documents WHERE doc_id IS NOT NULL")
def directory_reindex(s: SparkSession, d: str) -> DataFrame:
    """Files indexed twice: all are new, then all are as they were."""
    root = _folder_of_documents(s, d)
    engine = Engine(s, Config(index_path=scratch_path(s, "engine")))
    reports = [(run, engine.index_directory(root)) for run in ("first", "second")]
    return s.createDataFrame([(run, r.found, r.added, r.unchanged, r.errors) for run, r in reports], "run string, found bigint, added bigint, unchanged bigint, errors bigint")


@_register(
    "index_errors",
    """WITH old AS (SELECT id AS doc_id, path, modified_time FROM doc_meta WHERE id IS NOT NULL), new AS (SELECT id AS doc_id, path, modified_time, title IS NULL AS bad FROM corpus_docs WHERE id IS NOT NULL)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN new.doc_id IS NULL THEN 'deleted'
  WHEN old.doc_id IS NOT NULL AND old.path IS NOT DISTINCT FROM new.path AND old.modified_time IS NOT DISTINCT FROM new.modified_time THEN 'unchanged'
  WHEN bad THEN 'error' WHEN old.doc_id IS NULL THEN 'added' ELSE 'updated' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id""",
)
def index_errors(s: SparkSession, d: str) -> DataFrame:
    """A file that can't be read keeps the document it had; files without a title stand for such."""
    old = table(s, d, "doc_meta").where(F.col("id").isNotNull()).select(F.col("id").alias("doc_id"), "path", "modified_time")
    new = table(s, d, "corpus_docs").where(F.col("id").isNotNull()).select(F.col("id").alias("doc_id"), "path", "modified_time", F.when(F.col("title").isNull(), "unreadable").alias("error"))
    return index_diff(new, old)


@_register("index_roundtrip", _BASE + "SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions, token_count AS length FROM postings JOIN lens USING (doc_id)")
def index_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return prepared(s, d).postings.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "length")


@_register("load_errors", _values("damage, outcome", [("none", "loaded"), ("missing", "error"), ("format", "error"), ("version", "error"), ("header", "error")]))
def load_errors(s: SparkSession, d: str) -> DataFrame:
    """What a snapshot whose header is damaged answers to a load."""
    files, outcome = Files(s), []
    none = build_index(corpus(s, d).where(F.lit(False)))
    for damage, text in (("none", None), ("missing", None), ("format", '{"format": "other", "version": 2}'), ("version", '{"format": "termloom-index", "version": 999}'), ("header", "{")):
        path = scratch_path(s, "damaged")
        if damage != "missing":
            folder = save_index(none, path)
            if text:
                files.write(f"{folder}/_META.json", text)
        try:
            load_index(s, path)
            outcome.append((damage, "loaded"))
        except IndexLoadError:
            outcome.append((damage, "error"))
    return s.createDataFrame(outcome, "damage string, outcome string")


@_register(
    "evaluation_labels",
    """WITH r AS (SELECT DISTINCT query, relevant, unnest(relevant) AS ref FROM evaluation WHERE query IS NOT NULL)
SELECT DISTINCT query, c.id AS doc_id FROM r JOIN corpus_docs c ON c.path = 'corpus/' || r.ref""",
)
def evaluation_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels written as a JSON evaluation set, read back as stable ids."""
    path = scratch_path(s, "labels")
    rows = table(s, d, "evaluation").where(F.col("query").isNotNull()).select(F.struct("query", "relevant").alias("row"))
    # A file of one array per task.
    rows.groupBy(F.spark_partition_id().alias("part")).agg(F.to_json(F.collect_list("row")).alias("value")).repartition("part").select("value").write.text(path)
    judged = read_evaluation(s, path, "corpus").select("query", F.explode("relevant").alias("doc_id")).distinct()
    return judged.join(table(s, d, "corpus_docs").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


@_register("synthetic_documents", "SELECT range AS doc_id, 14 AS n_tokens FROM range(1000)")
def synthetic_documents(s: SparkSession, d: str) -> DataFrame:
    """Made-up documents of 12 words below a heading of two tokens."""
    return synthetic_corpus(s, 1000, 12).select("doc_id", F.size(kept_tokens(F.col("content"), ())).alias("n_tokens"))


@_register("config_values", _values("name, value", [("k1", "2.0"), ("b", "0.75"), ("default_ranker", "tfidf"), ("default_top_k", "10"), ("max_top_k", "100"), ("cache_capacity", "3"), ("snippet_context_chars", "120"), ("port", "9")]))
def config_values(s: SparkSession, d: str) -> DataFrame:
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".conf", delete=False) as f:  # read by the driver alone
        f.write("# comment\nbm25.k1 = 2.0 # more\nunknown = 1\nport=9\nno line\ndefault_ranker = tfidf\ncache_capacity = 3\n")
    c = load_config(f.name)
    os.unlink(f.name)
    names = ("k1", "b", "default_ranker", "default_top_k", "max_top_k", "cache_capacity", "snippet_context_chars", "port")
    return s.createDataFrame([(n, str(getattr(c, n))) for n in names], "name string, value string")


# --- analysis and lookups ---------------------------------------------------------------------------


@_register("custom_stop_words", _BASE.replace(f"NOT IN ({_STOPS})", "NOT IN ('index', 'the')") + "SELECT doc_id, pos::INT AS pos, term FROM occ")
def custom_stop_words(s: SparkSession, d: str) -> DataFrame:
    return explode_terms(table(s, d, "documents").where(F.col("doc_id").isNotNull()), "doc_id", "text", ("index", "the"))


@_register("path_hash_vectors", _values("path, id", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8"), (None, None)]))
def path_hash_vectors(s: SparkSession, d: str) -> DataFrame:
    """The public test vectors of the path hash."""
    return s.createDataFrame([("",), ("a",), ("foobar",), (None,)], "path string").select("path", path_id(F.col("path")).alias("id"))


_ASCII = "doc_id IS NOT NULL AND strlen(text) = length(text) AND contains(lower(text), 'index')"


@_register(
    "snippets_ascii",
    f"""WITH t AS (SELECT doc_id, text, translate(text, chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     ') AS flat, strpos(lower(text), 'index') - 1 AS low FROM documents WHERE {_ASCII}),
w AS (SELECT *, greatest(low - 60, 0) AS s0, least(length(text), greatest(low - 60, 0) + 125) AS e0 FROM t),
b AS (SELECT *, CASE WHEN s0 = 0 THEN 0 WHEN strpos(substr(flat, s0 + 1, e0 - s0), ' ') > 0 THEN s0 + strpos(substr(flat, s0 + 1, e0 - s0), ' ') - 1 ELSE e0 END AS s1 FROM w),
c AS (SELECT *, CASE WHEN e0 >= length(text) THEN e0 WHEN strpos(reverse(substr(flat, s1 + 2, e0 - s1)), ' ') > 0 THEN e0 + 1 - strpos(reverse(substr(flat, s1 + 2, e0 - s1)), ' ') ELSE s1 END AS e1 FROM b),
f AS (SELECT doc_id, text, CASE WHEN s1 < e1 THEN s1 ELSE 0 END AS s, CASE WHEN s1 < e1 THEN e1 ELSE least(length(text), 120) END AS e FROM c),
x AS (SELECT *, substr(text, s + 1, e - s) AS cut FROM f), y AS (SELECT *, strpos(lower(cut), 'index') AS m FROM x)
SELECT doc_id, (CASE WHEN s > 0 THEN '...' ELSE '' END) || (CASE WHEN m > 0 THEN substr(cut, 1, m - 1) || '<mark>' || substr(cut, m, 5) || '</mark>' || substr(cut, m + 5) ELSE cut END) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) AS snippet FROM y""",
)
def snippets_ascii(s: SparkSession, d: str) -> DataFrame:
    """Excerpts of all documents of one byte a character that hold a word."""
    docs = table(s, d, "documents").where(F.col("doc_id").isNotNull() & (F.octet_length("text") == F.length("text")) & F.contains(F.lower("text"), F.lit("index")))
    return docs.select("doc_id", snippet_column(F.col("text"), "index", 60).alias("snippet"))


@_register("document_lookup", _BASE + "SELECT doc_id, token_count, true AS known FROM lens WHERE doc_id IN (SELECT min(doc_id) FROM lens UNION SELECT max(doc_id) FROM lens) UNION ALL SELECT -5, -1, false")
def document_lookup(s: SparkSession, d: str) -> DataFrame:
    """The first and the last document and one that isn't there."""
    engine = engine_of(s, d)
    ids = [*table(s, d, "documents").agg(F.min("doc_id"), F.max("doc_id")).first(), -5]
    rows = [(i, (engine.get_document(i) or {"token_count": -1})["token_count"], engine.contains(i)) for i in ids]
    return s.createDataFrame(rows, "doc_id bigint, token_count int, known boolean")


@_register("postings_lookup", _BASE + "SELECT doc_id, tf FROM postings WHERE term = 'cache'")
def postings_lookup(s: SparkSession, d: str) -> DataFrame:
    return engine_of(s, d).postings_for("cache").select("doc_id", "tf")


@_register("live_ids", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL")
def live_ids(s: SparkSession, d: str) -> DataFrame:
    return engine_of(s, d).document_ids()


@_register("result_titles", _ranked_sql(["shard", "replica"], BOOLEAN["bool_or"][1], 10).replace(" SELECT (row_number()", ", top AS (SELECT (row_number()", 1) + ") SELECT rank, doc_id, doc_id::VARCHAR AS path FROM top")
def result_titles(s: SparkSession, d: str) -> DataFrame:
    return engine_of(s, d).results("shard OR replica").select("rank", "doc_id", "path")


@_register("clamped_topk", _ranked_sql(["index"], BOOLEAN["term_match"][1], 100))
def clamped_topk(s: SparkSession, d: str) -> DataFrame:
    """A thousand results asked for, a hundred given."""
    return engine_of(s, d).results("index", 1000).select("rank", "doc_id", F.round("score", DIGITS).alias("score"))


@_register("clamp_cases", _values("asked, given", [("None", 10), ("0", 10), ("-1", 10), ("5", 5), ("1000", 100)]))
def clamp_cases(s: SparkSession, d: str) -> DataFrame:
    engine = Engine(s, Config(index_path=scratch_path(s, "none")))
    return s.createDataFrame([(str(k), engine.clamp(k)) for k in (None, 0, -1, 5, 1000)], "asked string, given int")


@_register("phrase_match_sets", _BASE + f"SELECT DISTINCT doc_id FROM ({_phrase_sql('und', 'danach', 'den')})")
def phrase_match_sets(s: SparkSession, d: str) -> DataFrame:
    """A phrase by positional equi-joins."""
    return matches_by_sets(prepared(s, d), Phrase(("und", "danach", "den")))


@_register("length_percentiles", "WITH v AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT p, (SELECT n_chars FROM v WHERE k = trunc(p * (n - 1))) AS value FROM (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) t(p)")
def length_percentiles(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    p50, p99 = (percentile(docs, "n_chars", p).select(F.lit(p).alias("p"), "value") for p in (0.5, 0.99))
    return p50.unionByName(p99)


# --- parser, cache, adapters ------------------------------------------------------------------------


def shown(node: Node) -> str:
    """A tree in one line."""
    match node:
        case Term(value):
            return value or "-"
        case Phrase(words):
            return '"' + " ".join(words) + '"'
        case Not(child):
            return f"NOT({shown(child)})"
        case And(left, right):
            return f"AND({shown(left)}, {shown(right)})"
        case Or(left, right):
            return f"OR({shown(left)}, {shown(right)})"


#: Query texts and their trees; "error" where a text is none.
PARSED = {
    "machine": "machine", '"machine learning"': '"machine learn"', "a1 OR b1 AND c1": "OR(a1, AND(b1, c1))", "(a1 OR b1) AND c1": "AND(OR(a1, b1), c1)", "a1 AND NOT b1": "AND(a1, NOT(b1))",
    "a1 NOT b1": "AND(a1, NOT(b1))", "a1 b1 c1": "AND(AND(a1, b1), c1)", "NOT NOT a1": "NOT(NOT(a1))", "tcp and ip": "AND(tcp, ip)", "tcp oR ip": "OR(tcp, ip)", "c++": "c++", "-bio": "bio", "the": "-",
    "!a1 ? b1": "AND(a1, b1)", 'a1"b1 c1"': 'AND(a1, "b1 c1")', "tcp/ip": "tcp/ip", "AND x": "error", "x AND": "error", "x OR OR y": "error", "(x": "error", "x)": "error", '"x': "error", "": "error", " ": "error",
    "()": "error", "!!!": "error", '""': "error", '"the of"': "error", "NOT": "error", "a NOT": "error", "a" * 4097: "error", '"' + "x1 " * 33 + '"': "error",
}


@_register("parser_cases", _values("query, tree", PARSED.items()))
def parser_cases(s: SparkSession, d: str) -> DataFrame:
    def tree(q: str) -> str:
        try:
            return shown(parse_query(q))
        except QueryParseError:
            return "error"

    return s.createDataFrame([(q, tree(q)) for q in PARSED], "query string, tree string")


@_register("cache_trace", _values("step, value, hits, misses, kept", [(1, "None", 0, 1, 0), (2, "1", 1, 1, 2), (3, "None", 1, 2, 2), (4, "3", 2, 2, 2), (5, "None", 2, 3, 0)]))
def cache_trace(s: SparkSession, d: str) -> DataFrame:
    """A cache of two entries: a miss, a hit that keeps an entry young, the other one gone, the newest, none after invalidation."""
    c, out = ResponseCache(2), []

    def ask(key: str) -> None:
        out.append((len(out) + 1, str(c.get(key)), c.hits, c.misses, len(c)))

    ask("a")
    c.put("a", 1), c.put("b", 2)
    ask("a")
    c.put("c", 3)
    ask("b"), ask("c")
    c.invalidate_all()
    ask("a")
    return s.createDataFrame(out, "step int, value string, hits int, misses int, kept int")


@_register("cached_search", _values("turn, cache_hit, same", [(1, 0, 1), (2, 1, 1), (3, 0, 0)]))
def cached_search(s: SparkSession, d: str) -> DataFrame:
    """The same query twice, then with another ranker: only the second is answered from the cache."""
    engine = engine_of(s, d)
    first, second, other = engine.search("shard OR replica"), engine.search("shard OR replica"), engine.search("shard OR replica", ranker="tfidf")
    return s.createDataFrame([(i, int(r.cache_hit), int(r.results == first.results)) for i, r in enumerate((first, second, other), 1)], "turn int, cache_hit int, same int")


@_register("http_search", _ranked_sql(*RANKED["bm25_phrase_topk"][1:4]))
def http_search(s: SparkSession, d: str) -> DataFrame:
    """The ranking as the JSON of GET /search gives it."""
    status, out = respond(engine_of(s, d), "GET", "/search?q=" + quote(RANKED["bm25_phrase_topk"][0]))
    found = json.loads(json.dumps(out))["results"] if status == 200 else []
    rows = s.createDataFrame([(r["document_id"], float(r["score"])) for r in found], "doc_id bigint, score double")
    best = sorted(((round(r["score"], DIGITS), -r["document_id"]) for r in found), reverse=True)
    order = s.createDataFrame([(i, -k) for i, (_, k) in enumerate(best, 1)], "rank int, doc_id bigint")
    return rows.join(F.broadcast(order), "doc_id").select("rank", "doc_id", F.round("score", DIGITS).alias("score"))  # a row per result


_REQUESTS = (
    ("GET", "/health", "", 200), ("GET", "/search", "", 400), ("GET", "/search?q=x+AND", "", 400), ("GET", "/search?q=index&top_k=zz&ranker=tfidf", "", 200), ("GET", "/none", "", 404),
    ("GET", "/documents/-5", "", 404), ("GET", "/stats", "", 200), ("POST", "/index", "{}", 400), ("POST", "/index", "nope", 400), ("POST", "/index", '{"path": "/none/here"}', 400),
)


@_register("http_statuses", _values("method, target, body, status", _REQUESTS))
def http_statuses(s: SparkSession, d: str) -> DataFrame:
    engine = engine_of(s, d)
    return s.createDataFrame([(m, t, b, respond(engine, m, t, b.encode())[0]) for m, t, b, _ in _REQUESTS], "method string, target string, body string, status int")


@_register(
    "http_stats",
    _BASE + f"SELECT n_docs AS documents, (SELECT count(*) FROM terms) AS terms, total_tokens, round(avgdl, {DIGITS}) AS average_document_length FROM stats",
)
def http_stats(s: SparkSession, d: str) -> DataFrame:
    _, out = respond(engine_of(s, d), "GET", "/stats")
    row = (out["documents"], out["terms"], out["total_tokens"], round(out["average_document_length"], DIGITS))
    return s.createDataFrame([row], "documents bigint, terms bigint, total_tokens bigint, average_document_length double")


@_register("stream_upserts", "SELECT count(DISTINCT doc_id) AS documents FROM documents WHERE doc_id IS NOT NULL")
def stream_upserts(s: SparkSession, d: str) -> DataFrame:
    """All documents arriving as a file stream."""
    source = scratch_path(s, "arriving")
    table(s, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text").write.parquet(source)
    engine = Engine(s, Config(index_path=scratch_path(s, "engine")), id_type="bigint")
    arriving = s.readStream.schema("doc_id bigint, text string").parquet(source)
    upsert_stream(engine, arriving, "doc_id", "text", scratch_path(s, "progress")).awaitTermination()
    return engine.index.stats.select(F.col("n_docs").alias("documents"))
