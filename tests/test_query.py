import pytest

from termloom.plans.query import And, Not, Or, Phrase, QueryParseError, Term, holds, leaves, parse_query, scoring_leaves

A, B, C = Term("a1"), Term("b1"), Term("c1")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("machine", Term("machine")),
        ('"machine learning"', Phrase(("machine", "learn"))),
        ("a1 OR b1 AND c1", Or(A, And(B, C))),
        ("(a1 OR b1) AND c1", And(Or(A, B), C)),
        ("a1 AND NOT b1", And(A, Not(B))),
        ("a1 NOT b1", And(A, Not(B))),
        ("a1 b1 c1", And(And(A, B), C)),
        ("NOT NOT a1", Not(Not(A))),
        ("tcp and ip", And(Term("tcp"), Term("ip"))),
        ("c++", Term("c++")),
        ("-bio", Term("bio")),
        ("the", Term("")),
        ("!a1 ? b1", And(A, B)),
        ('a1"b1 c1"', And(A, Phrase(("b1", "c1")))),
    ],
)
def test_trees(text, tree):
    assert parse_query(text) == tree


@pytest.mark.parametrize("text", ["AND x", "x AND", "x OR OR y", "(x", "x)", '"x', "", " \t\n", "a" * 5000, "()", "!!!", '""', '"the of"', "NOT", '"' + "x1 " * 33 + '"', "a NOT", "é" * 2100])
def test_errors(text):
    with pytest.raises(QueryParseError):
        parse_query(text)


def test_scoring_leaves_flip_with_each_not():
    assert scoring_leaves(parse_query("a1 NOT (b1 AND NOT c1)")) == [A, C]
    assert scoring_leaves(parse_query("a1 a1 NOT b1")) == [A, A]
    assert leaves(parse_query("a1 NOT b1")) == [A, B]


def test_holds():
    t = parse_query("(a1 OR b1) NOT c1")
    assert holds(t, {A}) and not holds(t, {A, C}) and not holds(t, set()) and holds(parse_query("a1 OR NOT b1"), set())
