"""Tunables, and their `key = value` file form."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits of the query language.
MAX_QUERY_BYTES, MAX_PHRASE_TERMS = 4096, 32


@dataclass(frozen=True)
class Config:
    k1: float = 1.2
    b: float = 0.75
    default_ranker: str = "bm25"
    default_top_k: int = 10
    max_top_k: int = 100
    cache_capacity: int = 256
    snippet_context_chars: int = 120
    index_path: str = "./index"
    stop_words_path: str = ""
    host: str = "127.0.0.1"
    port: int = 8080


_KEYS = {"bm25.k1": ("k1", float), "bm25.b": ("b", float)} | {
    k: (k, kind)
    for k, kind in (
        ("default_ranker", str), ("default_top_k", int), ("max_top_k", int), ("cache_capacity", int), ("snippet_context_chars", int),
        ("index_path", str), ("stop_words_path", str), ("host", str), ("port", int),
    )
}


def load_config(path: str) -> Config:
    """Reads a file: `#` starts a comment anywhere, unknown keys and lines without `=` are ignored, a missing file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return Config()
    found = {}
    for line in lines:
        key, eq, value = line.partition("#")[0].partition("=")
        if eq and key.strip() in _KEYS:
            name, kind = _KEYS[key.strip()]
            found[name] = kind(value.strip())
    return replace(Config(), **found)


def stop_words_of(config: Config, default: tuple[str, ...]) -> tuple[str, ...]:
    """The words of the file at stop_words_path, one or more a line; the default where the path is empty or can't be read."""
    try:
        with open(config.stop_words_path, encoding="utf-8") as f:
            return tuple(f.read().split())
    except OSError:
        return default
