"""Markup residue in text: which constructs a field holds, and its clean text with the structure kept.

A field is read as a sequence of words and tags. Recognisers for HTML, Markdown, wiki text and LaTeX turn
constructs into text that keeps headings, lists, code and formulas, and leave a tag where the construct was. In the sequence words score
positive and tags negative, with weights fitted on labelled pages; one linear scan finds all maximal scoring runs. The scan's sum falls at tags only: a field in which it
falls holds markup, one in which it never does is a single run from end to end. The clean text is that of all runs, the content region the run of greatest score.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = (
    "html_tag", "html_comment", "html_entity", "md_heading", "md_rule", "md_list", "md_quote", "md_table", "md_emphasis", "md_strike", "md_code",
    "md_link", "md_image", "md_footnote", "formula", "wiki_heading", "wiki_list", "wiki_link", "wiki_template", "wiki_table", "wiki_emphasis",
    "wiki_magic", "latex_command", "latex_environment",
)
_TAG = {k: chr(0xF0000 + i) for i, k in enumerate(KINDS)}
_KIND = {c: k for k, c in _TAG.items()}
_OPEN, _CLOSE = "\U000f1000", "\U000f1001"  # around the number of a stashed piece
_PRIVATE = re.compile("[\U000f0000-\U000fffff]")
_STASHED = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
_PIECE = re.compile(f"[\U000f0000-\U000f00ff]|{_OPEN}\\d+{_CLOSE}|[^\\W_]+")

# Element names of HTML, and those common in wiki text.
HTML_NAMES = frozenset(
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr "
    "html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre "
    "progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track tt u ul var video wbr ref references nowiki math gallery syntaxhighlight poem includeonly noinclude onlyinclude".split()
)
_BARE = "checked|compact|controls|declare|defer|disabled|hidden|ismap|multiple|noshade|nowrap|open|readonly|required|reversed|selected"
_ATTRS = rf"(?:\s+(?:[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+)|(?:{_BARE})))*"
_HTML_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTRS})\s*(/?)>")
_BLOCKS = frozenset("p div tr table ul ol dl dt dd section article header footer blockquote center form figure figcaption caption hr br thead tbody body html head".split())


@dataclass
class Parsed:
    """tagged: the clean text with tag marks and stashed pieces; pieces: the stash; kinds: constructs by kind."""

    tagged: str
    pieces: list[str]
    kinds: Counter = field(default_factory=Counter)

    def clean(self, start: int = 0, end: int | None = None) -> str:
        """The text between two offsets of `tagged`, without marks, stash filled in, blank space tidied."""
        text = self.tagged[start:end]
        while _STASHED.search(text):  # a piece holds only earlier ones
            text = _STASHED.sub(lambda m: self.pieces[int(m.group(1))], text)
        text = _PRIVATE.sub("", text)
        text = re.sub(r"[ \t]+\n", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def _unescape(s: str) -> str:
    """HTML entities replaced; the marks in s stay, and no entity gives a new one."""
    return "".join(p if _PRIVATE.match(p) else _PRIVATE.sub("\ufffd", html.unescape(p)) for p in re.split(f"({_PRIVATE.pattern})", s))


class _Reader:
    def __init__(self, text: str):
        self.text = _PRIVATE.sub("\ufffd", text.replace("\r\n", "\n").replace("\r", "\n"))
        self.pieces: list[str] = []
        self.kinds: Counter = Counter()

    def tag(self, kind: str) -> str:
        self.kinds[kind] += 1
        return _TAG[kind]

    def stash(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"{_OPEN}{len(self.pieces) - 1}{_CLOSE}"

    def sub(self, need: str, pattern: re.Pattern, f: Callable[[re.Match], str]) -> None:
        """Replaces what the pattern finds; `need` holds the signs one of which every match has, so that a text without them isn't searched."""
        if any(c in self.text for c in need):
            self.text = pattern.sub(f, self.text)

    def sub_all(self, need: str, pattern: re.Pattern, f: Callable[[re.Match], str]) -> None:
        """The same until nothing is found: constructs inside one another, from the innermost out."""
        found = 1
        while found and any(c in self.text for c in need):
            self.text, found = pattern.subn(f, self.text)


def _c(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)


_M, _S, _I = re.MULTILINE, re.DOTALL, re.IGNORECASE
_COMMENT = _c(r"<!--(?:(?!<!--).)*?-->|<!--|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>|<!\[CDATA\[|\]\]>(?=\s|$)", _S | _I)
_HIDDEN = _c(r"<(script|style)\b[^>]*>.*?</\1\s*>", _S | _I)
_FENCE = _c(r"^[ \t]{0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", _M | _S)
_FENCE_LINE = _c(r"^[ \t]{0,3}(?:`{3,}|~{3,})[^\n`]*$", _M)
_PRE = _c(r"<(pre|syntaxhighlight|source)\b[^>]*>(.*?)</\1\s*>", _S | _I)
_CODE_TAG = _c(r"<(code|tt|kbd|samp|nowiki)\b[^>]*>([^<]*)</\1\s*>", _S | _I)
_VERBATIM = _c(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\]|\{[^}]*\})*(.*?)\\end\{\1\*?\}", _S)
_MATH_ENV = _c(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}", _S)
_MATH_TAG = _c(r"<math\b[^>]*>(.*?)</math\s*>", _S | _I)
_DISPLAY = _c(r"\$\$(?!\s*\$)(.+?)\$\$", _S)
_BRACKET = _c(r"\\\[((?:(?!\\\[).)+?)\\\]", _S)
_PAREN = _c(r"\\\(((?:(?!\\\().)+?)\\\)", _S)
_INLINE = _c(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?)(?<=[^\s\\])\$(?![\d$])")
_MATHY = _c(r"[\\^_{}=]|^\s*[A-Za-z]\s*$|[A-Za-z]\s*[-+*/<>]\s*\w|\w\s*[-+*/<>]\s*[A-Za-z]|^[A-Za-z]\([^)]*\)$")
_TICKS = _c(r"(?<!`)(`{1,2})(?!`)([^\n]*?[^\n`])\1(?!`)")
_DRIVE = _c(r"(?<![A-Za-z0-9])[A-Za-z]:(?:\\[\w.$ -]*\w)+\\?|(?<!\\)\\\\[\w.-]+(?:\\[\w.$-]+)+")
_L_HEAD = _c(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_L_ENV = _c(r"\\(begin|end)\{([A-Za-z]+\*?)\}((?:\[[^\]\n]*\]|\{[^{}\n]*\})*)")
_L_DROP = _c(r"~?\\(cite[a-z]*|ref|eqref|pageref|autoref|label|index|vspace|hspace|bibliography|bibliographystyle|usepackage|documentclass|input|include|includegraphics)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_L_ARG = _c(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}")
_L_ITEM = _c(r"^[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*", _M)
_L_BARE = _c(r"(?<![\w:\\/])\\([A-Za-z]{2,})\b\*?|(?<=[\s&])\\\\(?=\s|$)|(?<=\w)~?\\(?:ldots|dots|LaTeX|TeX|par|newline|hline|item)\b")
_W_TABLE = _c(r"^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-+[^\n|]*$|^[ \t]*\|\+[^\n]*$", _M)
_W_CELLS = _c(r"^[ \t]*[|!][ \t]*(?=\S)([^\n]*?(?:\|\||!!)[^\n]*)$", _M)
_W_REDIRECT = _c(r"^[ \t]*#REDIRECT\b:?", _M | _I)
_W_FILE = _c(r"\[\[(?:File|Image|Datei|Fichier|Archivo)\s*:[^\[\]|\n]*(?:\|([^\[\]\n]*))?\]\]", _I)
_W_CATEGORY = _c(r"\[\[:?(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]\n]*\]\]", _I)
_W_LINK = _c(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_W_EXTERNAL = _c(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\](?!\()")
_W_TEMPLATE = _c(r"\{\{([^{}]*)\}\}", _S)
_W_PARAM = _c(r"\{\{\{[^{}]*\}\}\}")
_W_OPEN_TEMPLATE = _c(r"\{\{[A-Za-z][^{}\n]*$|^\}\}[ \t]*$", _M)
_W_BOLD = _c(r"'''''(?=\S)((?:[^'\n]|'(?!'))+)'''''|'''(?=\S)((?:[^'\n]|'(?!''))+?)'''|(?<!')''(?=[^\s'])((?:[^'\n]|'(?!'))*[^\s'])''(?!')")
_W_HEAD = _c(r"^[ \t]*(={1,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", _M)
_W_MAGIC = _c(r"(?<!\w)__[A-Z]{3,}__(?!\w)|~{4,5}(?!\S)")
_ENTITY = _c(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_M_ATX = _c(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", _M)
_M_SETEXT = _c(r"^([ \t]*[^-*+>|#=\s][^\n]*)\n[ \t]{0,3}(=+|-{2,})[ \t]*$", _M)
_M_RULE = _c(r"^[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|={3,})$", _M)
_M_TABLE_RULE = _c(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", _M)
_M_TABLE = _c(r"^[ \t]*\|(?=[^\n]*\S)([^\n]*?)\|?[ \t]*$", _M)
_M_TASK = _c(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+\[([ xX])\][ \t]+(?=\S)", _M)
_M_LIST = _c(r"^([ \t]*)[-*+•][ \t]+(?=\S)", _M)
_M_NUMBER = _c(r"^([ \t]*)(\d{1,9})[.)][ \t]+(?=\S)", _M)
_W_LIST = _c(r"^[ \t]*([*#:;]{2,}|[#:;])[ \t]+(?=\S)", _M)
_M_QUOTE = _c(r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S)", _M)
_M_NOTE_DEF = _c(r"^[ \t]{0,3}\[\^[^\]\s]+\]:[ \t]*", _M)
_M_REF_DEF = _c(r"^[ \t]{0,3}\[([^\]\n^]+)\]:(?=[ \t]+\S)", _M)
_M_NOTE = _c(r"\[\^(?:[^\[\]\s]|\[(?!\^))+\]")
_M_IMAGE = _c(r"!\[([^\]\n]*)\](?:\([^()\n]*\)|\[[^\]\n]*\])")
_M_LINK = _c(r"(?<!!)\[([^\[\]\n]+)\]\([^()\s]*(?:[ \t]+[\"'(][^\n)]*)?\)")
_M_REF_LINK = _c(r"(?<![!\w\])])\[([^\[\]\n]+)\]\[([^\[\]\n]*)\](?!\[)")
_M_AUTO = _c(r"<(?:https?|ftp|mailto):[^\s<>]+>|<[\w.+-]+@[\w-]+\.[\w.]+>")
_M_STRIKE = _c(r"~~(?=[^\s~])((?:[^~\n]|~(?!~))*?[^\s~])~~(?!~)")
_M_BOLD = _c(r"(?<![*\\])\*{2,3}(?=[^\s*])((?:[^*\n]|\*(?!\*))*?[^\s*\\])\*{2,3}(?!\*)|(?<![\w\\])_{2,3}(?=[^\s_])((?:[^_\n]|_(?!_))*?[^\s_\\])_{2,3}(?!\w)")
_M_EM = _c(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*\\])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]*?[^\s_\\])_(?!\w)")
_M_INDENT = _c(r"(?:\A|(?<=\n\n))(?:(?: {4}|\t)[ \t]*\S[^\n]*(?:\n|\Z))+")


def _template(body: str) -> str:
    """The text a template shows as far as that can be told: its first unnamed parameter, or its named values."""
    parts = [p.strip() for p in body.split("|")]
    unnamed = [p for p in parts[1:] if p and "=" not in p]
    if unnamed:
        return unnamed[0]
    return "\n".join(p.partition("=")[2].strip() for p in parts[1:] if "=" in p)


def parse(text: str) -> Parsed:
    """Reads a field. The order matters: code and formulas first, so that nothing inside them counts again."""
    r = _Reader(text)
    tag, stash, sub = r.tag, r.stash, r.sub

    sub("<]", _COMMENT, lambda m: tag("html_comment"))
    sub("<", _HIDDEN, lambda m: tag("html_tag"))
    sub("`~", _FENCE, lambda m: tag("md_code") + stash(f"```{m.group(2).strip()}\n{m.group(3).rstrip()}\n```") + "\n")
    sub("`~", _FENCE_LINE, lambda m: tag("md_code"))
    sub("<", _PRE, lambda m: tag("html_tag") + stash("\n```\n" + _unescape(re.sub(r"</?code[^>]*>", "", m.group(2), flags=re.I)).strip() + "\n```\n"))
    sub("<", _CODE_TAG, lambda m: tag("html_tag") + stash(f"`{_unescape(m.group(2))}`"))
    sub("\\", _VERBATIM, lambda m: tag("latex_environment") + stash(f"\n```\n{m.group(2).strip()}\n```\n"))
    sub("\\", _MATH_ENV, lambda m: tag("formula") + stash(f"$$ {m.group(3).strip()} $$"))
    sub("<", _MATH_TAG, lambda m: tag("formula") + stash(f"${m.group(1).strip()}$"))
    sub("`", _TICKS, lambda m: tag("md_code") + stash(f"`{m.group(2).strip()}`"))
    sub("$", _DISPLAY, lambda m: tag("formula") + stash(f"$$ {m.group(1).strip()} $$"))
    sub("\\", _BRACKET, lambda m: tag("formula") + stash(f"$$ {m.group(1).strip()} $$"))
    sub("\\", _PAREN, lambda m: tag("formula") + stash(f"${m.group(1).strip()}$"))
    sub("$", _INLINE, lambda m: tag("formula") + stash(f"${m.group(1)}$") if _MATHY.search(m.group(1)) else m.group(0))
    sub("\\", _DRIVE, lambda m: stash(m.group(0)))

    sub("\\", _L_HEAD, lambda m: tag("latex_command") + stash("#" * (1 + m.group(1).count("sub") + (m.group(1) == "section"))) + " " + m.group(2))
    sub("\\", _L_DROP, lambda m: tag("latex_command"))
    in_table = bool(re.search(r"\\begin\{tabular", r.text))
    sub("\\", _L_ENV, lambda m: tag("latex_environment"))
    if in_table:
        sub("&", _c(r"[ \t]&[ \t]"), lambda m: " | ")
    # What a note says stays, in brackets.
    r.sub_all("\\", _L_ARG, lambda m: tag("latex_command") + (f" ({m.group(2)})" if m.group(1) in ("footnote", "footnotetext", "thanks") else m.group(2)))
    sub("\\", _L_ITEM, lambda m: tag("latex_command") + stash("-") + " " + (m.group(1) or ""))
    sub("\\", _L_BARE, lambda m: tag("latex_command"))
    sub("~", _c(r"(?<=\w)~(?=[A-Za-z\U000f0000-\U000fffff])"), lambda m: " ")

    sub("#", _W_REDIRECT, lambda m: tag("wiki_magic"))
    sub("{", _W_PARAM, lambda m: tag("wiki_template"))
    r.sub_all("{", _W_TEMPLATE, lambda m: tag("wiki_template") + _template(m.group(1)))
    sub("{}", _W_OPEN_TEMPLATE, lambda m: tag("wiki_template"))
    sub("[", _W_FILE, lambda m: tag("wiki_link") + ((m.group(1) or "").split("|")[-1]))
    sub("[", _W_CATEGORY, lambda m: tag("wiki_link"))
    sub("[", _W_LINK, lambda m: tag("wiki_link") + (m.group(2) or m.group(1)))
    sub("[", _W_EXTERNAL, lambda m: tag("wiki_link") + (m.group(1) or ""))
    wiki_table = "{|" in r.text
    sub("|", _W_TABLE, lambda m: tag("wiki_table"))
    if wiki_table or "||" in r.text:
        sub("|!", _W_CELLS, lambda m: tag("wiki_table") + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)))
    sub("'", _W_BOLD, lambda m: tag("wiki_emphasis") + next(g for g in m.groups() if g is not None))
    sub("=", _W_HEAD, lambda m: tag("wiki_heading") + stash("#" * len(m.group(1))) + " " + m.group(2))
    sub("_~", _W_MAGIC, lambda m: tag("wiki_magic"))

    sub("<", _M_AUTO, lambda m: tag("md_link") + m.group(0)[1:-1])

    def element(m: re.Match) -> str:
        name, closing = m.group(2).lower(), m.group(1)
        if name not in HTML_NAMES:
            return m.group(0)
        mark = tag("html_tag")
        if re.fullmatch("h[1-6]", name):
            return mark + ("\n\n" if closing else "\n" + stash("#" * int(name[1])) + " ")
        if name == "li":
            return mark + ("\n" if closing else "\n" + stash("-") + " ")
        if name in ("td", "th"):
            return mark + (" " if closing else " | ")
        inline = closing and m.end() < len(m.string) and m.string[m.end()] not in "\n<"  # a stray end tag amid a sentence
        return mark + ("\n" if name in _BLOCKS and not inline else "")

    sub("<", _HTML_TAG, element)

    def entity(m: re.Match) -> str:
        if m.group(1)[0] != "#" and m.group(1) + ";" not in html5:
            return m.group(0)
        return tag("html_entity") + stash(_unescape(m.group(0)).replace("\xa0", " "))

    sub("&", _ENTITY, entity)

    sub("[", _M_TASK, lambda m: m.group(1) + tag("md_list") + stash("-") + (" [x] " if m.group(2) in "xX" else " [ ] "))
    sub("[", _M_NOTE_DEF, lambda m: tag("md_footnote"))
    sub("[", _M_REF_DEF, lambda m: tag("md_link") + m.group(1) + ":")
    sub("#", _M_ATX, lambda m: tag("md_heading") + stash(m.group(1)) + " " + m.group(2))
    sub("=-", _M_SETEXT, lambda m: tag("md_heading") + stash("#" if m.group(2)[0] == "=" else "##") + " " + m.group(1).strip())
    sub("-*_=", _M_RULE, lambda m: tag("md_rule"))
    sub("|", _M_TABLE_RULE, lambda m: tag("md_table") if "|" in m.group(0) else m.group(0))
    sub("|", _M_TABLE, lambda m: tag("md_table") + stash("|") + m.group(1).rstrip() + " |")
    sub("*#:;", _W_LIST, lambda m: tag("wiki_list") + stash("-") + " ")
    sub("-*+•", _M_LIST, lambda m: m.group(1) + tag("md_list") + stash("-") + " ")
    sub(".)", _M_NUMBER, lambda m: m.group(1) + tag("md_list") + stash(m.group(2) + ".") + " ")
    sub(">", _M_QUOTE, lambda m: tag("md_quote"))
    sub("\t ", _M_INDENT, lambda m: tag("md_code") + m.group(0))
    sub("!", _M_IMAGE, lambda m: tag("md_image") + m.group(1))
    sub("[", _M_LINK, lambda m: tag("md_link") + m.group(1))
    sub("[", _M_NOTE, lambda m: tag("md_footnote"))
    sub("[", _M_REF_LINK, lambda m: tag("md_link") + m.group(1))
    sub("~", _M_STRIKE, lambda m: tag("md_strike") + m.group(1))
    sub("*_", _M_BOLD, lambda m: tag("md_emphasis") + (m.group(1) or m.group(2)))
    sub("*_", _M_EM, lambda m: tag("md_emphasis") + (m.group(1) or m.group(2)))
    return Parsed(r.text, r.pieces, r.kinds)


# --- content region -------------------------------------------------------------------------------

# Labelled pages: blocks and whether they belong to the content.
LABELLED: tuple[tuple[tuple[str, bool], ...], ...] = (
    (
        ('<div class="nav"><a href="/">Home</a> <a href="/all">All</a></div>', False),
        ("<h1>Caches</h1><p>A cache keeps what was read so that it need not be read again soon.</p>", True),
        ('<hr><a href="/imprint">Imprint</a>', False),
    ),
    (
        ("[Home](/) | [Index](/index) | [Tags](/tags)", False),
        ("# Locks\n\nA lock lets one writer in and keeps the others waiting until it is done.\n\n- shared locks\n- exclusive locks", True),
        ("[^1] [up](#top) [next](/n)", False),
    ),
    (
        ("{{navbox|left}}", False),
        ("== Queues ==\nA queue hands its entries out in the order in which they came, which is '''fair'''.", True),
        ("[[Category:Data]] [[Category:Order]]", False),
    ),
    (
        ("\\usepackage{math}\\input{head}", False),
        ("\\section{Trees}\nA tree with n leaves has a depth of at least the logarithm of n, as \\emph{every} level doubles.", True),
        ("\\bibliography{all}\\label{end}", False),
    ),
    (
        ("<!-- top --><span>Menu</span>", False),
        ("The index is written in the background while readers go on with the version they have opened.", True),
        ("<script>count()</script>&nbsp;", False),
    ),
    (
        ("![logo](logo.png) ![badge](badge.png)\n\n---", False),
        ("> A page is read once.\n\nThe **first** reader pays for it, which `read_page` counts, and ~~never~~ seldom waits.\n\n```\nread_page(7)\n```", True),
        ("| name | bytes |\n|---|---|\n| page | 4096 bytes for every page that is read from disk |", True),
        ("The cost is $c = n \\log n$ for n pages, see the plan ![plan](plan.png) and the note[^2] below.", True),
        ("---\n\n[Back](/) [Next](/n)", False),
    ),
    (
        ("__NOTOC__ __NOEDITSECTION__ {{stub}}", False),
        ("** each segment holds its own terms\n** each merge joins two of them into one larger segment", True),
        ("{| class=\"wide\"\n|-\n| segment || number of documents in it\n|-\n| first || four thousand of them\n|}", True),
        ("A '''merge''' is done when [[segment|segments]] of one size are many &ndash; seldom more than ten.", True),
        ("{| class=\"navbox\"\n|-\n| [[A]] || [[B]]\n|}", False),
    ),
    (
        ("\\begin{document}\\maketitle", False),
        ("\\begin{itemize}\n\\item the leaf holds the keys\n\\item the root holds the way to them\n\\end{itemize}", True),
        ("The height is \\( h \\) and grows with \\[ \\log n \\] as keys are added to the tree.", True),
        ("\\end{document}", False),
    ),
)


def _classes(text: str) -> Iterator[str]:
    for m in _PIECE.finditer(parse(text).tagged):
        yield _KIND.get(m.group(0), "word")


def fit_weights(pages: Iterable[Iterable[tuple[str, bool]]]) -> dict[str, float]:
    """Weight per class of piece from labelled pages: log odds of content, smoothed; words at least 0.1, tags at most -0.1."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for block, is_content in page:
            (inside if is_content else outside).update(_classes(block))
    a, b = sum(inside.values()) + len(KINDS) + 1, sum(outside.values()) + len(KINDS) + 1
    odds = {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in (*KINDS, "word")}
    return {k: max(v, 0.1) if k == "word" else min(v, -0.1) for k, v in odds.items()}


WEIGHTS = fit_weights(LABELLED)


@dataclass(frozen=True)
class Scan:
    """runs: (start, end, score) of all maximal scoring runs of a field, in order; fall: by how much its tags made the sum fall."""

    runs: list[tuple[int, int, float]]
    fall: float

    @property
    def region(self) -> tuple[int, int, float]:
        """The first run of greatest score; (0, 0, 0.0) without words."""
        return max(self.runs, key=lambda r: r[2], default=(0, 0, 0.0))


def scan(parsed: Parsed, weights: dict[str, float] = WEIGHTS) -> Scan:
    """All maximal runs in one pass: runs that no longer run beats and that meet only at pieces that would lower them.

    A run is kept with the sums before and after it. A piece that raises the sum opens a run, which takes in the runs back to the last one that began lower, if
    that one ended lower as well. Each run is taken in at most once.
    """
    runs: list[list] = []  # start, end, sum before, sum after, the nearest earlier run that begins lower
    total = fall = 0.0
    for m in _PIECE.finditer(parsed.tagged):
        before, weight = total, weights[_KIND.get(m.group(0), "word")]
        total += weight
        if weight <= 0:
            fall -= weight
            continue
        new = [m.start(), m.end(), before, total, -1]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= new[2]:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= new[3]:
                new[4] = j
                runs.append(new)
                break
            new[0], new[2] = runs[j][0], runs[j][2]
            del runs[j:]
    return Scan([(s, e, after - before) for s, e, before, after, _ in runs], fall)


def clean_markup(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, clean_text, region_text, score, runs, fall, tags, kinds): one row per record and field that isn't null.

    clean_text is the text of all runs and what stands between them but tags, region_text the best content region (from whole lines) with its score, runs the number
    of maximal runs, fall by how much the scan's sum fell: 0 where the field holds no construct. tags is the number of constructs, kinds
    their kinds in order of name. Null fields give no row, empty ones empty texts; texts are read whole; other columns are ignored.
    """
    long = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("v"))
    rows = long.select("id", "v.field", "v.text").where(F.col("text").isNotNull())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                p = parse(text)
                found = scan(p)
                start, end, score = found.region
                start = p.tagged.rfind("\n", 0, start) + 1
                end = p.tagged.find("\n", end) if "\n" in p.tagged[end:] else len(p.tagged)
                out.append((p.clean(), p.clean(start, end), score, len(found.runs), found.fall, sum(p.kinds.values()), sorted(p.kinds)))
            done = pd.DataFrame(out, columns=["clean_text", "region_text", "score", "runs", "fall", "tags", "kinds"])
            yield pd.concat([b[["id", "field"]].reset_index(drop=True), done], axis=1)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(read, f"id {kind}, field string, clean_text string, region_text string, score double, runs int, fall double, tags int, kinds array<string>")
