"""Command line: index, search, stats, save, serve."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from termloom.config import load_config, stop_words_of
from termloom.engine import Engine
from termloom.functions.analyze import STOP_WORDS
from termloom.plans.query import QueryParseError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("--config", default="termloom.conf")
    p.add_argument("--index", dest="index_path")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("index").add_argument("directory")
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top", type=int)
    s.add_argument("--ranker")
    commands.add_parser("stats")
    commands.add_parser("save")
    v = commands.add_parser("serve")
    v.add_argument("--host")
    v.add_argument("--port", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 1 for a query that can't be parsed, a missing index or files that couldn't be indexed."""
    args = _parser().parse_args(argv)
    config = load_config(args.config)
    if args.index_path:
        config = replace(config, index_path=args.index_path)
    engine = Engine(spark or SparkSession.builder.appName("termloom").getOrCreate(), config, stop_words_of(config, STOP_WORDS))
    loaded = engine.load_if_present()
    if args.command == "index":
        try:
            r = engine.index_directory(args.directory)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
        print(f"found {r.found}, added {r.added}, updated {r.updated}, deleted {r.deleted}, unchanged {r.unchanged}, errors {r.errors} in {r.duration_ms:.0f} ms")
        for e in r.error_rows.orderBy("path").toLocalIterator():
            print(f"  {e['path']}: {e['error']}")
        return int(r.errors > 0)
    if args.command == "serve":
        from termloom.http import serve

        serve(engine, args.host or config.host, args.port or config.port)
        return 0
    if not loaded:
        print(f"no index at {config.index_path}", file=sys.stderr)
        return 1
    if args.command == "search":
        try:
            response = engine.search(args.query, args.top, args.ranker)
        except QueryParseError as e:
            print(f"query error: {e}", file=sys.stderr)
            return 1
        print(f"{response.total_candidates} candidates, {response.duration_ms:.1f} ms, {response.ranker}")
        for i, x in enumerate(response.results, 1):
            print(f"{i}. {x.title} ({x.path}) {x.score:.3f}\n   {x.snippet}")
    elif args.command == "stats":
        s = engine.stats()
        lines = (
            f"documents {s.documents}", f"terms {s.terms}", f"tokens {s.total_tokens}", f"average length {s.average_document_length:.2f}",
            f"size {s.index_size_bytes} bytes", f"cache hits {s.cache_hits}, misses {s.cache_misses}, rate {s.hit_rate:.2f}",
        )
        print("\n".join(lines))
    else:
        print("the index is saved whenever it is built")
    return 0


if __name__ == "__main__":
    sys.exit(main())
