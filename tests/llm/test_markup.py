import random

import pytest

from termloom.llm.markup import _KIND, _PIECE, KINDS, LABELLED, WEIGHTS, clean_markup, fit_weights, parse, scan

MARKED = {
    "md_heading": ["# Head", "### Head ##", "Head\n====", "Some head\n---"], "md_rule": ["a\n\n---\n\nb", "* * *"], "md_list": ["- one\n- two", "3. three", "* [x] done", "+ plus"],
    "md_quote": ["> said"], "md_table": ["| a | b |\n|---|---|\n| 1 | 2 |"], "md_emphasis": ["a **bold** b", "an *em* b", "a __b__ c", "an _em_ b"], "md_strike": ["a ~~b~~ c"],
    "md_code": ["a `b` c", "```py\nx = 1\n```", "~~~\nx\n~~~", "```\nopen"], "md_link": ["a [b](c.md) d", "a [b][c] d", "see <https://x.org/a>", "[b]: http://x.org"], "md_image": ["a ![b](c.png)"],
    "md_footnote": ["a[^1] b", "[^1]: note"], "formula": ["$$ s = \\sum_i w_i $$", "a $x_{i}$ b", "\\( a \\le b \\)", "\\[ a \\]", "a~$\\alpha$", "$O(n \\log n)$"],
    "wiki_heading": ["== Head ==", "= Head ="], "wiki_list": ["** nested", ": indented"], "wiki_link": ["a [[b]] c", "[[b (c)|d]]", "[[Category:X]]", "[[File:a.png|thumb|b]]", "[http://x.org b]"],
    "wiki_template": ["{{see|x}}", "{{infobox\n| a = b\n}}"], "wiki_table": ["{| class=\"x\"\n|-\n| a || b\n|}"], "wiki_emphasis": ["a '''b''' c", "a ''b'' c"], "wiki_magic": ["__NOTOC__", "#REDIRECT [[x]]"],
    "html_tag": ["<p>a</p>", "a<br/>b", "a </p> b", "<H1 class=top>a", "<td nowrap>a"], "html_comment": ["a <!-- b --> c"], "html_entity": ["a &amp; b", "a&nbsp;b", "it&#39;s", "&#x27;"],
    "latex_command": ["\\section{A}", "a \\textbf{b}", "x\\footnote{y}", "a~\\cite{b:1}", "\\item a"], "latex_environment": ["\\begin{itemize}\nx\n\\end{itemize}"],
}
PLAIN = [
    "If x < y and y > z the sum holds.", "It costs $5 to $9 today.", "They count 3 * 600 * 128 rows.", "The path C:\\temp\\beacon is long.", "R&D tested it; all fine.", "Set {a, b} is small.", "The state a->b holds.",
    "C++ and C# code", "See note #7 on it.", "A size of 2^10 bytes", "about ~256 items", "The file lib/core_crawl.c is checked.", "The name max_page_size stays.", "The tester [sic] sorted it.", "warm -- or not -- it runs", "at 500% of it",
    "A: b, c (see above)", "don't say 'it' or \"that\"", "", "one\n\ntwo\n three", "snake_case and __init", "f(x) = 3 and 5 > 4", "a & b", "List<T> of x", "50 * 2", "\\\\server\\share\\x", "a | b", "e.g. 1) first", "\u200bodd\ufffd",
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in MARKED.items() for t in ts])
def test_constructs_are_found(kind, text):
    assert kind in parse(text).kinds


@pytest.mark.parametrize("text", PLAIN)
def test_signs_of_prose_are_none(text):
    assert not parse(text).kinds, text


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<h2>Head</h2>\n<p>a <b>b</b>&nbsp;c</p><ul><li>one</li><li>two</li></ul>", "## Head\n\na b c\n\n- one\n\n- two"),
        ("== Head ==\nThe '''bold''' [[b|link]] and {{term|word}}.", "## Head\nThe bold link and word."),
        ("\\section{Head}\nSome \\emph{text}~\\cite{x} with $a_{1}$.", "## Head\nSome text with $a_{1}$."),
        ("Head\n====\n\n```py\nx = *y*\n```\n\n1. a\n2. **b**", "# Head\n\n```py\nx = *y*\n```\n\n1. a\n2. b"),
        ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "- one\n- two"),
        ("a ![img](x.png) b[^2] ~~c~~", "a img b c"),
        ("<pre><code>x &lt; y\n</code></pre>", "```\nx < y\n```"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n\n| 1 | 2 |"),
        ("plain text", "plain text"),
    ],
)
def test_clean_text_keeps_structure(text, clean):
    assert parse(text).clean() == clean


def test_weights_and_region():
    w = fit_weights(LABELLED)
    assert w["word"] > 0 and all(v < 0 for k, v in w.items() if k != "word")
    page = "<div><a href='/'>Home</a> <a href='/x'>All</a></div>\n" + "A plain sentence with quite a few words in it. " * 3 + "\n<div><a href='/i'>Imprint</a></div>"
    p = parse(page)
    start, end, score = scan(p).region
    assert p.tagged[start:end].strip().startswith("A plain") and score > 0 and "Imprint" not in p.tagged[start:end]
    assert scan(parse("")).region == (0, 0, 0.0) and scan(parse("<br><br>")).region == (0, 0, 0.0)


def brute_runs(weights):
    """Maximal runs by their definition: the run of greatest score, the shortest of several, then the same left and right of it."""
    best = max(((sum(weights[i:j]), -(j - i), -i, i, j) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3:]
    return brute_runs(weights[:i]) + [(i, j)] + [(i + j_, j + j_) for i, j, j_ in ((a, b, j) for a, b in brute_runs(weights[j:]))]


def test_all_maximal_runs():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["word ", "word ", "<b>", "*em* ", "<br>", "[a](b) "]) for _ in range(rnd.randint(0, 14)))
        p = parse(text)
        pieces = list(_PIECE.finditer(p.tagged))
        weights = [WEIGHTS[_KIND.get(m.group(0), "word")] for m in pieces]
        want = [(pieces[i].start(), pieces[j - 1].end()) for i, j in brute_runs(weights)]
        found = scan(p)
        assert [r[:2] for r in found.runs] == want, text
        assert (found.fall > 0) == (sum(p.kinds.values()) > 0)
        if not found.fall:
            assert len(found.runs) == min(1, len(pieces))
    assert len(scan(parse("word <b> " * 50_000)).runs) > 0  # linear


def test_notes_and_definitions_stay():
    assert parse("A claim\\footnote{key fact} holds.").clean() == "A claim (key fact) holds."
    assert parse("A claim\\footnote{see \\emph{key} fact}.").clean() == "A claim (see key fact)."
    assert parse("See [a][b].\n\n[b]: http://x.org/a Title").clean() == "See a.\n\nb: http://x.org/a Title"


def test_no_construct_is_too_long_or_too_deep():
    p = parse("so $x = " + "y + " * 200 + "z$ holds")
    assert p.kinds == {"formula": 1} and p.clean().endswith("y + z$ holds")
    assert parse("a[^" + "n" * 60 + "] b").clean() == "a b" and parse("[^" * 20000).kinds["md_footnote"] == 0
    assert parse("\\emph{a " * 7 + "b" + "}" * 7).clean() == "a " * 7 + "b"
    assert parse("{{see|a " * 7 + "b" + "}}" * 7).clean() == "a " * 7 + "b"
    nested = r"\( \[ $$ `<math>\begin{equation}x = 1\end{equation}</math>` $$ \] \)"
    assert parse(nested).clean() == "$$$ $$ `$$$ x = 1 $$$` $$ $$$"
    assert parse("<code>&#xF1000;0&#xF1001;</code> &#xF1000;1&#xF1001;").clean() == "`\ufffd0\ufffd` \ufffd1\ufffd"


def test_labelled_pages_hold_every_kind():
    held = {k for page in LABELLED for block, _ in page for k in parse(block).kinds}
    assert held == set(KINDS)


def test_operator(spark):
    schema = "id string, content string, title string, field string, tags int, text string"
    rows = [("a", "# H\n\nx", "T"), ("b", None, None), ("c", "", "**t**"), (None, "plain", "<b>x"), ("a", "# H\n\nx", "T"), ("l", "w " * 100000 + "*e*", "\U000f0001 private \U000f1000" + "0\U000f1001")]
    df = clean_markup(spark.createDataFrame([(*r, "f", 1, "t") for r in rows], schema), "id", ["content", "title"])
    got = sorted(((r["id"], r["field"], r["tags"]) for r in df.collect()), key=repr)
    assert got == sorted([("a", "content", 1), ("a", "title", 0), ("c", "content", 0), ("c", "title", 1), (None, "content", 0), (None, "title", 1), ("a", "content", 1), ("a", "title", 0), ("l", "content", 1), ("l", "title", 0)], key=repr)
    assert clean_markup(spark.createDataFrame([], schema), "id", ["content"]).count() == 0
