"""Text analysis: tokens, ASCII folding, stop words, suffix stemmer, titles.

Each step exists as a Column function (stays in the JVM) and as a plain Python twin for query text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default stop words and the letters that case folding touches.
STOP_WORDS = tuple(
    "the a an is of to in on and or are was were be been being it this that as at by for from with not but if "
    "then than so such no nor too very can will just do does did has have had i you he she we they him her its "
    "our your their".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"

_TOKEN_PY = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_FOLD = str.maketrans(UPPER, LOWER)


def tokens(text: Column) -> Column:
    """All tokens of a text in order, case kept; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def ascii_lower(word: Column) -> Column:
    """Folds A-Z only; other letters stay."""
    return F.translate(word, UPPER, LOWER)


def stem(word: Column) -> Column:
    """Suffix stemmer on a folded token; lengths count bytes, the first rule that fits wins."""
    n = F.octet_length(word)

    def ends(suffix: str, longer: int) -> Column:
        return word.endswith(suffix) & (n > longer)

    def drop(k: int) -> Column:
        return F.left(word, F.length(word) - F.lit(k))

    without_ing = drop(3)
    undoubled = F.when(
        F.right(without_ing, F.lit(1)) == F.left(F.right(without_ing, F.lit(2)), F.lit(1)), F.when(F.length(without_ing) > 1, drop(4)).otherwise(without_ing)
    ).otherwise(without_ing)
    return (
        F.when(n <= 3, word)
        .when(ends("ies", 4), F.concat(drop(3), F.lit("y")))
        .when(ends("ing", 5), undoubled)
        .when(ends("ness", 5) | ends("ment", 5), drop(4))
        .when(ends("ed", 4) | ends("ly", 4) | ends("es", 4), drop(2))
        .when(ends("s", 3) & ~word.endswith("ss"), drop(1))
        .otherwise(word)
    )


def kept_tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Folded tokens without stop words, not yet stemmed; offsets in this array are the index positions."""
    words = list(stop_words)
    folded = tokens(F.translate(text, UPPER, LOWER))
    return F.filter(folded, lambda w: ~w.isin(words)) if words else folded


def terms(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """The normalized term array of a text."""
    return F.transform(kept_tokens(text, stop_words), stem)


def explode_terms(df: DataFrame, id_col: str, text_col: str, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, pos, term) rows. Stemming runs after the explode, as generated code over plain columns."""
    kept = df.select(F.col(id_col).alias("doc_id"), F.posexplode(kept_tokens(F.col(text_col), stop_words)).alias("pos", "word"))
    return kept.select("doc_id", "pos", stem(F.col("word")).alias("term"))


def title(text: Column, fallback: Column) -> Column:
    """First line that isn't blank, heading marks removed when a space follows them; else the fallback.

    Null text counts as empty.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return F.coalesce(F.regexp_replace(first, "^#+ ", ""), fallback)


# --- Python twins, used on query text -------------------------------------------------------------


def py_tokens(text: str) -> list[str]:
    return _TOKEN_PY.findall(text)


def py_lower(word: str) -> str:
    return word.translate(_FOLD)


def py_stem(word: str) -> str:
    n = len(word.encode())
    rules = ((("ies",), 4, 3), (("ing",), 5, 3), (("ness", "ment"), 5, 4), (("ed", "ly", "es"), 4, 2), (("s",), 3, 1))
    if n <= 3:
        return word
    for suffixes, longer, cut in rules:
        if not word.endswith(suffixes) or n <= longer or (suffixes == ("s",) and word.endswith("ss")):
            continue
        left = word[:-cut]
        if suffixes == ("ies",):
            return left + "y"
        if suffixes == ("ing",) and len(left) > 1 and left[-1] == left[-2]:
            return left[:-1]
        return left
    return word


def py_normalize(word: str, stop_words: Iterable[str] = STOP_WORDS) -> str:
    """The term of one word; "" means dropped."""
    low = py_lower(word)
    return "" if low in set(stop_words) else py_stem(low)


def py_terms(text: str, stop_words: Iterable[str] = STOP_WORDS) -> list[str]:
    stops = set(stop_words)
    return [py_stem(low) for low in map(py_lower, py_tokens(text)) if low not in stops]
