"""The query language: NOT binds tighter than AND (also implied between neighbours), AND tighter than OR."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from termloom.config import MAX_PHRASE_TERMS, MAX_QUERY_BYTES
from termloom.functions.analyze import STOP_WORDS, py_normalize, py_terms


class QueryParseError(ValueError):
    """A query that the language has no meaning for."""


@dataclass(frozen=True)
class Term:
    value: str  # normalized; "" for a stop word, which matches nothing


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    child: Node


Node = Term | Phrase | And | Or | Not
Leaf = Term | Phrase

# A word starts with a letter, digit or non-ASCII character and runs to a blank, parenthesis or quote; other signs between words are skipped.
_LEXEMES = re.compile(r'"(?P<phrase>[^"]*)"|(?P<open>\()|(?P<close>\))|(?P<word>[A-Za-z0-9\u0080-\U0010ffff][^ \t\r\n\v\f()"]*)|(?P<quote>")')


def _lexemes(text: str) -> Iterator[tuple[str, str]]:
    for m in _LEXEMES.finditer(text):
        kind, value = m.lastgroup or "", m.group(m.lastgroup or 0)
        if kind == "quote":
            raise QueryParseError("unterminated phrase")
        if kind == "word" and value.isascii() and value.upper() in ("AND", "OR", "NOT"):
            yield value.upper(), value
        else:
            yield kind, value
    yield "end", ""


class _Parser:
    def __init__(self, text: str, stop_words: Iterable[str]):
        self.items, self.at, self.stop_words = list(_lexemes(text)), 0, frozenset(stop_words)

    @property
    def kind(self) -> str:
        return self.items[self.at][0]

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1][1]

    def operand_follows(self) -> bool:
        return self.kind in ("word", "phrase", "open", "NOT")

    def operator(self) -> None:
        """Skips an operator, which needs an operand after it."""
        name = self.take()
        if not self.operand_follows():
            raise QueryParseError(f"expected an operand after {name.upper()}")

    def any_of(self) -> Node:
        node = self.all_of()
        while self.kind == "OR":
            self.operator()
            node = Or(node, self.all_of())
        return node

    def all_of(self) -> Node:
        node = self.negated()
        while self.kind == "AND" or self.operand_follows():
            if self.kind == "AND":
                self.operator()
            node = And(node, self.negated())
        return node

    def negated(self) -> Node:
        negations = 0
        while self.kind == "NOT":
            self.operator()
            negations += 1
        node = self.primary()
        for _ in range(negations):
            node = Not(node)
        return node

    def primary(self) -> Node:
        kind = self.kind
        if kind == "word":
            return Term(py_normalize(self.take(), self.stop_words))
        if kind == "phrase":
            found = tuple(py_terms(self.take(), self.stop_words))
            if not found:
                raise QueryParseError("a phrase without any term")
            if len(found) > MAX_PHRASE_TERMS:
                raise QueryParseError(f"a phrase of more than {MAX_PHRASE_TERMS} terms")
            return Phrase(found)
        if kind == "open":
            self.take()
            node = self.any_of()
            if self.kind != "close":
                raise QueryParseError("missing ')'")
            self.take()
            return node
        raise QueryParseError("an operand is missing at the end" if kind == "end" else f"no operand begins with '{self.items[self.at][1]}'")


def parse_query(text: str, stop_words: Iterable[str] = STOP_WORDS) -> Node:
    """The tree of a query; terms are normalized, not tokenized. Raises QueryParseError."""
    if not text.strip(" \t\r\n"):
        raise QueryParseError("there is nothing to search for")
    if len(text.encode("utf-8", "surrogatepass")) > MAX_QUERY_BYTES:
        raise QueryParseError(f"query longer than {MAX_QUERY_BYTES} bytes")
    parser = _Parser(text, stop_words)
    node = parser.any_of()
    if parser.kind != "end":
        raise QueryParseError(f"'{parser.items[parser.at][1]}' stands where the query could end")
    return node


def leaves(node: Node) -> list[Leaf]:
    """All leaves from left to right, repeated ones too."""
    match node:
        case Term() | Phrase():
            return [node]
        case Not(child):
            return leaves(child)
        case And(left, right) | Or(left, right):
            return leaves(left) + leaves(right)


def scoring_leaves(node: Node, negated: bool = False) -> list[Leaf]:
    """Leaves under an even number of NOTs from left to right; a repeated leaf scores repeatedly."""
    match node:
        case Term() | Phrase():
            return [] if negated else [node]
        case Not(child):
            return scoring_leaves(child, not negated)
        case And(left, right) | Or(left, right):
            return scoring_leaves(left, negated) + scoring_leaves(right, negated)


def holds(node: Node, present: set[Leaf]) -> bool:
    """Whether a document with just these leaves matches."""
    match node:
        case Term() | Phrase():
            return node in present
        case Not(child):
            return not holds(child, present)
        case And(left, right):
            return holds(left, present) and holds(right, present)
        case Or(left, right):
            return holds(left, present) or holds(right, present)
