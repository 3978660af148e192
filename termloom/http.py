"""HTTP adapter over the engine: JSON in and out, standard library only."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from termloom.engine import Engine
from termloom.plans.query import QueryParseError


def respond(engine: Engine, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON object for a request."""
    url = urlsplit(target)
    args = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    try:
        if method == "GET" and url.path == "/health":
            return 200, {"status": "ok"}
        if method == "GET" and url.path == "/stats":
            return 200, asdict(engine.stats())
        if method == "GET" and url.path == "/search":
            return _search(engine, args)
        if method == "POST" and url.path == "/index":
            return _index(engine, body)
        if method == "GET" and url.path.startswith("/documents/"):
            found = engine.get_document(unquote(url.path.removeprefix("/documents/")))
            if not found:
                return 404, {"error": "document not found"}
            return 200, {"id": found["doc_id"]} | {k: found[k] for k in ("title", "path", "token_count")}
        return 404, {"error": "not found"}
    except Exception as e:  # whatever goes wrong becomes an answer
        return 500, {"error": str(e)}


def _search(engine: Engine, args: dict[str, str]) -> tuple[int, dict]:
    if not args.get("q"):
        return 400, {"error": "missing parameter q"}
    top = int(args["top_k"]) if args.get("top_k", "").isdecimal() else None
    try:
        return 200, asdict(engine.search(args["q"], top, args.get("ranker")))
    except QueryParseError as e:
        return 400, {"error": str(e)}


def _index(engine: Engine, body: bytes) -> tuple[int, dict]:
    try:
        path = json.loads(body or b"{}").get("path")
    except (ValueError, AttributeError):
        path = None
    if not path:
        return 400, {"error": "missing field path"}
    try:
        r = engine.index_directory(path)
    except FileNotFoundError as e:
        return 400, {"error": str(e)}
    return 200, {"documents_indexed": r.added + r.updated + r.unchanged, "errors": r.errors, "duration_ms": r.duration_ms}


def make_server(engine: Engine, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = self.headers.get("Content-Length", "0")
            body = self.rfile.read(int(size)) if size.isdecimal() else b""
            status, out = respond(engine, method, self.path, body)
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str, port: int) -> None:
    """Answers until interrupted."""
    server = make_server(engine, host, port)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
