"""Texts cut off by field limits or in transfer.

A text is either whole or cut, which isn't seen; what is seen is drawn from the whole table:

- its length: per source a log-normal length distribution is fitted by maximum likelihood with the values at candidate limits
  taken as right-censored; how far a limit's count exceeds what the fit expects there gives the posterior that a value of that length was censored;
- its announced size: whether it is more than the text has;
- its ending: which kind of ending it is, and for endings in a list item, table, address, signature, tag line or dots whether they are whole or
  only the beginning of what other texts end in.

The censoring posterior is each text's prior of being cut. How often cut and whole texts show each ending and each announced size isn't set by hand but
fitted to the table by expectation-maximisation: endings that abound at the limits beyond what is usual elsewhere come out as those of cut texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.runtime import written

#: Log odds of a cut that each ending has in a table that says nothing; see fit_evidence for their weight.
FIRST_ODDS = {
    "marked": 9.0, "fence": 9.0, "tag": 7.0, "open": 9.0, "left_out": -2.0,
    "sentence": -9.0, "code": -9.0, "symbol": -6.0, "bracket": -6.0,
    "dots": -6.0, "list": -6.0, "row": -6.0, "address": -6.0, "signature": -6.0, "tags": -6.0, "heading": -4.0,
}
#: Endings that are compared with those of other texts, the log odds of one that is only a beginning of them, and of dots after a word that no other sentence ends in.
COMPARED = ("list", "row", "address", "signature", "tags", "heading", "dots")
FIRST_PART_ODDS, FIRST_DOTS_PART_ODDS, FIRST_NEW_ODDS = 7.0, 3.0, -1.0
#: How much oftener longer endings must be seen for one to be a beginning of them; a word before dots may be the singular of one that is usual.
PART_TIMES, DOTS_PART_TIMES = 20, 4

_STOP = ".!?。！？．؟।"
_CLOSERS = "\"'”’»）)]】」』*_`"
_LEFT_OUT = re.compile(r"(?:…|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\))(?:\s*[(\[<][^()\[\]<>]*[)\]>])?$|\ufffd+$")
_ELEMENT = re.compile(r"</[A-Za-z][A-Za-z0-9]*\s*>|<br\s*/?>|<!--.*-->", re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{1,6});")
_BEGUN_ENTITY = re.compile(r"&(?:#\d*|[A-Za-z]+)")
_FENCE = re.compile(r"^[ \t]{0,3}(?:`{3,}|~{3,})", re.M)
_LIST = re.compile(r"\s*(?:[-*+•‣]|\d{1,4}[.)])\s+\S")
_ADDRESS = re.compile(r"(?:https?|ftp)://\S*$|^\s*(?:[^\W\d]+\W+){1,4}(?:[\w.-]+/)+[\w.-]*$|\S+@\S*$|^\s*www\.\S+$")
_SIGNATURE = re.compile(r"\s*(?:--+|—|–)\s*\S")
_TAGS = re.compile(r"\s*[^\W\d_]+\s*:\s*[^\W_][\w -]*(?:,[\w -]*)+$|\s*(?:#\w+\s*)+$")
_EYES = re.compile(r"\s[:;8=][-']?$")
_MOUTHS = ")(DPp|/\\oO3*"
_SYMBOLS = re.compile(r"[^\W\d_]+|\d+|\s+|.")
_WORDS = re.compile(r"[^\W_]+")


def _is_symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Sm", "Sc", "Cf", "Mn", "Me", "Co") and c not in "<>=+|~^$`"


def ending(text: str) -> tuple[str, str, str]:
    """(kind, line, word) of a text that isn't blank: the last line of endings that are compared, the last word of these and of sentences, else ""."""
    end = text.rstrip()
    line = end[end.rfind("\n") + 1 :]
    if len(_FENCE.findall(end)) % 2:
        return "fence", "", ""
    if _FENCE.match(line):
        return "code", "", ""
    if m := _LEFT_OUT.search(line):
        before = end[: len(end) - len(line) + m.start()].rstrip()
        return ("left_out" if _finished(before) else "marked"), "", ""
    if _open_tag(line) and not _finished(end):
        return "tag", "", ""
    bare = _without_closed_html(end)
    if not bare:
        return "symbol", "", ""
    closed_markup = len(bare) < len(end)
    structural = _structure(line)
    if structural and not closed_markup:
        return structural, line.strip(), _last_word(line) if line[-1:].isalnum() else ""
    if bare.endswith("..."):
        rest = bare.rstrip(".").rstrip()
        if not rest or rest[-1] in _STOP + _CLOSERS:
            return "sentence", "", ""
        return "dots", "", _last_word(rest)
    if _finished(bare):
        return "sentence", "", _last_word(bare)
    if closed_markup:
        return "symbol", "", ""
    if (at := _aside(line)) >= 0 or (at := _smiley(line)) >= 0:
        before = line[:at].rstrip()
        return ("bracket" if not before or _finished(before) else "open"), "", ""
    return "open", "", ""


def _open_tag(line: str) -> bool:
    """Whether a line ends inside a tag or an entity."""
    at = line.rfind("<")
    if at >= 0 and ">" not in line[at:] and re.match(r"<[/!A-Za-z]", line[at : at + 2]):
        return True
    at = line.rfind("&")
    return at >= 0 and _BEGUN_ENTITY.fullmatch(line, at) is not None


def _without_closed_html(s: str) -> str:
    """s without the end tags, comments, line breaks and entities at its end."""
    while True:
        s = s.rstrip()
        if s.endswith(">"):
            at, pattern = s.rfind("<!--") if s.endswith("-->") else s.rfind("<"), _ELEMENT
        elif s.endswith(";"):
            at, pattern = s.rfind("&"), _ENTITY
        else:
            return s
        if at < 0 or not pattern.fullmatch(s, at):
            return s
        s = s[:at]


def _aside(s: str) -> int:
    """Where an aside in brackets of any length that ends s begins, else -1."""
    if s[-1:] not in (")", "]"):
        return -1
    at = max(s.rfind(c, 0, -1) for c in "()[]\n")
    return at if at >= 0 and s[at] in "([" and at < len(s) - 2 else -1


def _smiley(s: str) -> int:
    """Where a smiley that ends s begins, else -1."""
    head = s.rstrip(_MOUTHS)
    m = _EYES.search(head[-3:]) if len(head) < len(s) else None
    return len(head) - len(head[-3:]) + m.start() if m else -1


def _finished(s: str) -> bool:
    """Whether s ends a sentence: a stop, perhaps closing marks, asides or symbols after it."""
    while True:
        s = s.rstrip()
        end = len(s)
        while end and (s[end - 1] in _CLOSERS or _is_symbol(s[end - 1]) or s[end - 1].isspace()):
            end -= 1
        if end and s[end - 1] in _STOP:
            return True
        if (at := max(_smiley(s), _aside(s))) < 0:
            return False
        s = s[:at]


def _structure(line: str) -> str:
    if _LIST.match(line) and not _finished(line):
        return "list"
    if line.lstrip().startswith("|") or line.endswith("|") and " | " in line:
        return "row"
    if _SIGNATURE.match(line) and not _finished(line):
        return "signature"
    if line.lstrip().startswith("#") and not _finished(line):
        return "heading"
    if _ADDRESS.search(line):
        return "address"
    if _TAGS.match(line):
        return "tags"
    return ""


def _last_word(s: str) -> str:
    end = len(s)
    while end and not _WORDS.match(s[end - 1]):
        end -= 1
    start = end
    while start and _WORDS.match(s[start - 1]):
        start -= 1
    return s[start:end]


def beginnings(symbols: Iterator[str], group: str) -> list[int]:
    """A hash of each beginning of a sequence of symbols, the last that of the whole; other groups have other hashes. Linear in the sequence."""
    h, out = 0xCBF29CE484222325, []
    for part in (group, *symbols):
        for b in part.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out.append(h - (h >> 63 << 64))
    return out[1:]


def _shape(line: str) -> list[str]:
    """A line with every word, number and blank as one symbol."""
    return ["w" if x[0].isalpha() else "9" if x[0].isdigit() else " " if x.isspace() else x for x in _SYMBOLS.findall(line)]


def endings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, text, n_chars, n_bytes, announced, kind, shape, word, parts) of every text that isn't null or blank.

    text is a hash of the text; shape and word are hashes of the last line's shape and of the last word where these are compared, else null; parts those of their proper beginnings.
    """
    columns = [F.col(id_col).alias("doc_id"), "source", F.col("declared_bytes").alias("announced"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")]
    rows = docs.select(*columns).where(F.trim(F.col(text_col), F.lit(" \t\r\n\f 　")) != "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [(i, t) for i, t in enumerate(b["text"].tolist()) if t.strip()]
            at = [i for i, _ in kept]
            out = []
            for _, t in kept:
                kind, line, word = ending(t)
                shape = beginnings(_shape(line), f"{kind} ") if line else []
                # A finished sentence's last words serve as those of sentences with trailing dots.
                letters = beginnings(word, "dots" if kind == "sentence" else kind) if word else []
                out.append((kind, shape[-1] if shape else None, letters[-1] if letters else None, shape[:-1] + letters[:-1]))
            yield pd.DataFrame(
                {
                    "doc_id": pd.Series([x for x in b["doc_id"].iloc[at].tolist()], dtype=object),
                    "source": pd.Series(b["source"].iloc[at].tolist(), dtype=object),
                    "text": b["hash"].iloc[at].to_numpy(),
                    "n_chars": [len(t) for _, t in kept],
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for _, t in kept],
                    "announced": b["announced"].iloc[at].to_numpy(dtype=float),
                    "kind": pd.Series([x[0] for x in out], dtype=object),
                    "shape": pd.array([x[1] for x in out], dtype="Int64"),
                    "word": pd.array([x[2] for x in out], dtype="Int64"),
                    "parts": pd.Series([x[3] for x in out], dtype=object),
                }
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(read, f"doc_id {kind}, source string, text bigint, n_chars bigint, n_bytes bigint, announced double, kind string, shape bigint, word bigint, parts array<bigint>")


# --- lengths ---------------------------------------------------------------------------------------


def _log_phi(z: np.ndarray) -> np.ndarray:
    return -0.5 * z * z - 0.5 * math.log(2 * math.pi)


def _upper(z: np.ndarray) -> np.ndarray:
    return np.maximum(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)]), 1e-300)


def fit_censored(x: np.ndarray, n: np.ndarray, limits: np.ndarray, censored: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Mean and deviation of log lengths by maximum likelihood: values x seen n times, `censored` values known to reach `limits`.

    Expectation-maximisation: a censored value counts as its conditional mean and variance beyond its limit.
    """
    total = n.sum() + censored.sum()
    mean = float((n @ x + censored @ limits) / total)
    dev = max(0.05, math.sqrt(float((n @ (x - mean) ** 2 + censored @ (limits - mean) ** 2) / total)))
    for _ in range(rounds):
        z = (limits - mean) / dev
        hazard = np.exp(_log_phi(z)) / _upper(z)
        at = mean + dev * hazard
        spread = dev * dev * np.clip(1 + z * hazard - hazard * hazard, 0, 1)
        new = float((n @ x + censored @ at) / total)
        var = float((n @ (x - new) ** 2 + censored @ (spread + (at - new) ** 2)) / total)
        step = abs(new - mean) + abs(math.sqrt(var) - dev)
        mean, dev = new, max(0.05, math.sqrt(var))
        if step < 1e-6:
            break
    return mean, dev


#: Bins per power of two of length, and the log odds against a given length being a limit before its count is seen.
PER_OCTAVE, AGAINST_LIMIT = 8, 12.0


def limit_posteriors(measured: DataFrame) -> DataFrame:
    """(source, unit, at, count, censored): candidate limits of each source, in chars or bytes, and the posterior that a value of just that length was censored.

    Copies of a text in a source count once. The histogram combines in each task. How much likelier a length's count is as its own mean than as that of the other lengths of its bin (Poisson
    likelihood ratio), against AGAINST_LIMIT, is the posterior that it is a limit; few values suffice in a small source, a large one needs more. To the fit of a source go its bins, at most
    64 * PER_OCTAVE a unit, and per bin the candidates' sums; the posterior of each candidate then follows from its source's fit by a join, so their number isn't limited.
    """
    keys = ["source", "unit"]
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("at")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("at"))))
    by_length = measured.select("source", "n_chars", "n_bytes", "text").distinct().select("source", units.alias("u")).groupBy("source", "u.unit", "u.at").agg(F.count("*").alias("n")).where(F.col("at") > 0)
    lengths = written(by_length.withColumn("bin", F.floor(F.log2("at") * PER_OCTAVE)), "lengths")
    width = F.greatest(F.lit(1.0), F.floor(F.pow(F.lit(2.0), (F.col("bin") + 1) / PER_OCTAVE)) - F.ceil(F.pow(F.lit(2.0), F.col("bin") / PER_OCTAVE)) + 1)
    bins = lengths.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum(F.log("at") * F.col("n")).alias("logs"), F.max(width).alias("width"))
    same = F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.unit") == F.col("b.unit")) & (F.col("l.bin") == F.col("b.bin"))
    usual = (F.col("b.n") - F.col("l.n") + 0.5) / F.col("b.width")
    log_ratio = F.col("count") * F.log(F.col("count") / F.col("usual")) - (F.col("count") - F.col("usual"))
    limit = 1 / (1 + F.exp(AGAINST_LIMIT - F.col("log_ratio")))
    peaks = lengths.where(F.col("n") > 1).alias("l").join(bins.alias("b"), same).select("l.source", "l.unit", "l.bin", "l.at", F.col("l.n").alias("count"), usual.alias("usual"))
    peaks = peaks.where(F.col("count") > F.col("usual")).withColumn("log_ratio", log_ratio).where(F.col("log_ratio") > AGAINST_LIMIT / 2).withColumn("limit", limit)
    candidates = written(peaks.withColumn("excess", F.col("limit") * (F.col("count") - F.col("usual"))), "limits")
    taken = candidates.groupBy(*keys, "bin").agg(F.sum("excess").alias("excess"), (F.sum(F.log("at") * F.col("excess")) / F.sum("excess")).alias("at"))
    t = F.col("t.bin") == F.col("b.bin")
    joined = bins.alias("b").join(taken.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.unit") == F.col("t.unit")) & t, "left")
    to_fit = joined.select("b.source", "b.unit", "b.n", "b.logs", F.coalesce("t.excess", F.lit(0.0)).alias("excess"), F.coalesce("t.at", F.lit(0.0)).alias("limit"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, excess = rows["n"].to_numpy(dtype=float), rows["excess"].to_numpy(dtype=float)
        x = rows["logs"].to_numpy(dtype=float) / n
        at_limit = excess > 0
        mean, dev = fit_censored(x, np.maximum(n - excess, 0.0), rows["limit"].to_numpy(dtype=float)[at_limit], excess[at_limit])
        names = {"source": pd.Series([key[0]], dtype=object), "unit": pd.Series([key[1]], dtype=object)}
        return pd.DataFrame(names | {"mean": [mean], "dev": [dev], "total": [float(n.sum())]})

    fits = to_fit.groupBy(*keys).applyInPandas(fit, "source string, unit string, mean double, dev double, total double")
    c = candidates.alias("c").join(fits.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.unit") == F.col("f.unit")))
    z = (F.log("c.at") - F.col("f.mean")) / F.col("f.dev")
    expected = F.col("f.total") * F.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * F.col("f.dev") * F.col("c.at"))
    # Where other lengths nearby are more frequent than the fit has it, they count.
    censored = F.col("c.limit") * F.greatest(F.least(1 - F.greatest(expected, F.col("c.usual")) / F.col("c.count"), F.lit(1 - 1e-4)), F.lit(0.0))
    return c.select("c.source", "c.unit", "c.at", "c.count", censored.alias("censored"))


# --- putting it together --------------------------------------------------------------------------

#: Whether the announced size is more than the text has. One that is the same isn't told from none: it may have been noted after the cut.
ANNOUNCED = ("more", "other")
#: Shares of texts, cut and whole, with each announced size, and the share of texts cut elsewhere than at a limit, in a table that says nothing.
FIRST_ANNOUNCED = ((0.3, 0.7), (0.02, 0.98))
FIRST_ELSEWHERE = 0.02
#: What the first values weigh against the table, as shares of its rows: those of cut texts little, as limits show how these end; those of whole texts as much as
#: the table, which shows no text that is surely whole.
FIRST_WEIGHT_CUT, FIRST_WEIGHT_WHOLE = 0.1, 1.0


def _first_odds(kind: str) -> float:
    name, _, how = kind.partition(":")
    return {"part": FIRST_DOTS_PART_ODDS if name == "dots" else FIRST_PART_ODDS, "new": FIRST_NEW_ODDS}.get(how, FIRST_ODDS[name])


def fit_evidence(cells: pd.DataFrame, rounds: int = 300) -> tuple[dict[str, float], dict[str, float], float]:
    """(log odds of a cut by kind of ending, by announced size, share of texts cut elsewhere than at a limit).

    cells: kind, announced, censored (the posterior, 0 where the length is no limit), n. Expectation-maximisation over cut and whole texts, in which ending and announced
    size are independent given which it is and the length's posterior is the prior. The first values count as shares of the rows, so that the result
    is the same for a table and for the table ten times over.
    """
    kinds = sorted(set(cells["kind"]))
    k, a = cells["kind"].map({x: i for i, x in enumerate(kinds)}).to_numpy(), cells["announced"].map({x: i for i, x in enumerate(ANNOUNCED)}).to_numpy()
    w, n = cells["censored"].to_numpy(dtype=float), cells["n"].to_numpy(dtype=float)
    first = np.array([1 / (1 + math.exp(-_first_odds(x))) for x in kinds])
    of_cut, of_whole = first / first.sum(), (1 - first) / (1 - first).sum()
    size_cut, size_whole = (np.array(x) for x in FIRST_ANNOUNCED)
    q, p, sq, sp, elsewhere = of_cut, of_whole, size_cut, size_whole, FIRST_ELSEWHERE
    for _ in range(rounds):
        prior = 1 - (1 - w) * (1 - elsewhere)
        cut, whole = prior * q[k] * sq[a], (1 - prior) * p[k] * sp[a]
        r = cut / (cut + whole)
        rn, wn = r * n, (1 - r) * n
        # An ending counts as one of cut texts by what is sure of it, its number less a standard deviation.
        seen = np.bincount(k, rn, len(kinds))
        seen = np.maximum(seen - np.sqrt(seen), 0.0)
        weight, other = FIRST_WEIGHT_CUT * rn.sum() + 1, FIRST_WEIGHT_WHOLE * wn.sum() + 1
        q = (weight * of_cut + seen) / (weight + seen.sum())
        p = (other * of_whole + np.bincount(k, wn, len(kinds))) / (other + wn.sum())
        sq = (weight * size_cut + np.bincount(a, rn, len(ANNOUNCED))) / (weight + rn.sum())
        sp = (other * size_whole + np.bincount(a, wn, len(ANNOUNCED))) / (other + wn.sum())
        free = ((1 - w) * n).sum()
        elsewhere = (FIRST_WEIGHT_CUT * free * FIRST_ELSEWHERE + ((rn * elsewhere * (1 - w)) / prior).sum()) / ((1 + FIRST_WEIGHT_CUT) * free)
    return dict(zip(kinds, np.log(q / p).tolist(), strict=True)), dict(zip(ANNOUNCED, np.log(sq / sp).tolist(), strict=True)), float(elsewhere)


def _compared(measured: DataFrame) -> DataFrame:
    """Adds `how`: "part" where the ending is a beginning of what other texts of the kind end in far oftener than in itself, "new" where dots follow a word
    that no other sentence ends in, else null.

    Counts of whole endings and of beginnings combine in each task; only texts of the kinds compared take part in the joins, sentences in the counts alone.
    """
    whole = measured.select(F.explode(F.array("shape", "word")).alias("h")).where(F.col("h").isNotNull()).groupBy("h").agg(F.count("*").alias("n"))
    longer = measured.select(F.explode("parts").alias("h")).groupBy("h").agg(F.count("*").alias("longer"))
    times = F.coalesce(F.col("longer") / F.col("n"), F.lit(0.0))
    told = whole.join(longer, "h", "left").where((times >= DOTS_PART_TIMES) | (F.col("n") == 1)).select("h", "n", times.alias("times"))
    asked, rest = measured.where(F.col("kind").isin(*COMPARED)), measured.where(~F.col("kind").isin(*COMPARED))
    for what in ("shape", "word"):
        asked = asked.join(told.select(F.col("h").alias(what), F.col("n").alias(f"{what}_n"), F.col("times").alias(f"{what}_times")), what, "left")
    dots = F.col("kind") == "dots"
    part = F.greatest(*(F.coalesce(f"{what}_times", F.lit(0.0)) for what in ("shape", "word"))) >= F.when(dots, DOTS_PART_TIMES).otherwise(PART_TIMES)
    judged = F.when(part, "part").when(dots & (F.col("word_n") == 1), "new")
    columns = [c for c in measured.columns if c not in ("text", "shape", "word", "parts")]
    return asked.select(*columns, judged.alias("how")).unionByName(rest.select(*columns, F.lit(None).cast("string").alias("how")))


def truncation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, kind, length_odds, announced_odds, ending_odds, is_cut): one row per text that isn't null or blank.

    docs: id, text, source, declared_bytes. Null sources form a source of their own; a null announced size says nothing;
    repeated rows are judged each; an empty table gives no rows; other columns are ignored; texts are read whole. A text is cut if the three log odds add up to more than 0;
    the last two are fitted by fit_evidence to counts of (kind, announced size, posterior in 40 steps), a table that doesn't grow with the data.
    """
    measured = written(endings(docs, id_col, text_col), "endings")
    # An announced size may be in characters; NaN: it was null.
    more = ~F.isnan("announced") & (F.col("announced") > F.col("n_bytes") + 2) & (F.col("announced") != F.col("n_chars"))
    limits = limit_posteriors(measured).where(F.col("censored") > 0)
    # A byte limit may fall inside a character, which then is left out; not in a text of one byte a character.
    short = F.sequence(F.lit(0), F.when(F.col("unit") == "bytes", 3).otherwise(0))
    spread = limits.select("source", "unit", "at", "censored", F.explode(short).alias("short")).select("source", "unit", (F.col("at") - F.col("short")).alias("at"), "censored", "short")
    reached = written(spread.groupBy("source", "unit", "at").agg(F.max("censored").alias("censored"), F.max(F.when(F.col("short") == 0, F.col("censored"))).alias("exact")), "reached")
    m = _compared(measured.withColumn("announced", F.when(F.coalesce(more, F.lit(False)), "more").otherwise("other")))
    for unit in ("chars", "bytes"):
        at = reached.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("at").alias("a"), F.col("censored").alias(unit), F.col("exact").alias(f"{unit}_exact"))
        m = m.join(at, m["source"].eqNullSafe(F.col("s")) & (m[f"n_{unit}"] == F.col("a")), "left").drop("s", "a")
    m = m.withColumn("bytes", F.when(F.col("n_bytes") > F.col("n_chars"), F.col("bytes")).otherwise(F.col("bytes_exact")))
    rows = written(m.select("doc_id", "source", F.concat_ws(":", "kind", "how").alias("kind"), "announced", F.coalesce(F.greatest("chars", "bytes"), F.lit(0.0)).alias("censored")), "evidence")
    step = F.when(F.col("censored") > 0, F.floor(2 * F.log(F.col("censored") / (1 - F.col("censored")))))
    cells = rows.groupBy("kind", "announced", step.alias("step")).agg(F.avg("censored").alias("censored"), F.count("*").alias("n")).orderBy("kind", "announced", "step").toPandas()
    by_kind, by_size, elsewhere = fit_evidence(cells) if len(cells) else ({"": 0.0}, {"": 0.0}, 0.0)
    prior = 1 - (1 - F.col("censored")) * (1 - elsewhere)

    def odds(table: dict[str, float], column: str) -> Column:
        return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col(column)]

    scored = rows.select("doc_id", "source", "kind", F.log(prior / (1 - prior)).alias("length_odds"), odds(by_size, "announced").alias("announced_odds"), odds(by_kind, "kind").alias("ending_odds"))
    return scored.withColumn("is_cut", F.col("length_odds") + F.col("announced_odds") + F.col("ending_odds") > 0)


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(source, texts, cut, rate): how often each source truncates; null sources as one."""
    n = F.count("*")
    cut_ = F.sum(F.col("is_cut").cast("bigint"))
    return judged.groupBy("source").agg(n.alias("texts"), cut_.alias("cut"), (cut_ / n).alias("rate"))
