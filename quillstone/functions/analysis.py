"""Analyzers: each as a Column for documents and as a host function for query strings.

The two forms must agree, or matching silently breaks; tests compare them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the stop analyzer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

# Folds that canonical decomposition does not give.
FOLDS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ĳ": "IJ", "ĳ": "ij", "ß": "ss", "ẞ": "SS", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d",
    "Ø": "O", "ø": "o", "Þ": "TH", "þ": "th", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "Ŀ": "L", "ŀ": "l", "ı": "i", "Ŋ": "N", "ŋ": "n", "Ə": "E", "ə": "e",
    "«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-",
}
# The letters that the search-side tokenizer folds, one to one.
ONE_TO_ONE = {
    c: base
    for base, letters in {
        "a": "àáâãäå", "A": "ÀÁÂÃÄÅ", "c": "ç", "C": "Ç", "e": "èéêë", "E": "ÈÉÊË", "i": "ìíîï", "I": "ÌÍÎÏ", "n": "ñ", "N": "Ñ", "o": "òóôõö", "O": "ÒÓÔÕÖ",
        "u": "ùúûü", "U": "ÙÚÛÜ", "y": "ýÿ", "Y": "ÝŸ",
    }.items()
    for c in letters
}

_SPLITS = {"standard": r"[^\p{L}\p{N}]+", "simple": r"[^\p{L}]+", "stop": r"[^\p{L}]+", "norm": r"[^\p{L}\p{N}]+"}
_NOT_SPACE = r"(?U)\s+"


def _unmarked(text: str) -> str:
    """Canonical decomposition without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")


def fold(text: str | None) -> str | None:
    """ASCII folding: the table above, then canonical decomposition without marks."""
    if text is None or text.isascii():
        return text
    return _unmarked("".join(FOLDS.get(c, c) for c in text))


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """By rule from the character database: letters and what single character each becomes (those beyond are dropped), and the longer folds."""
    single, gone, longer = {}, [], {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x30000))):
        folded = fold(c)
        if folded != c:
            if len(folded) == 1:
                single[c] = folded
            elif folded:
                longer[c] = folded
            else:
                gone.append(c)
    return "".join(single) + "".join(gone), "".join(single.values()), longer


def asciifold(c: Column) -> Column:
    """ASCII folding of a column, inside the JVM; Hangul syllables fall into their letters by arithmetic."""
    given, wanted, longer = _fold_tables()
    out = F.translate(c, given, wanted)
    for a, b in longer.items():
        out = F.when(F.contains(out, F.lit(a)), F.replace(out, F.lit(a), F.lit(b))).otherwise(out) if a not in FOLDS else F.replace(out, F.lit(a), F.lit(b))
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def split_up(x: Column) -> Column:
        n = F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
        last = n % 28
        return F.concat(letter((n / 588).cast("int") + 0x1100), letter((n % 588 / 28).cast("int") + 0x1161), F.when(last > 0, letter(last + 0x11A7)).otherwise(""))

    korean = F.array_join(F.transform(F.split(out, ""), lambda x: F.when(x.between("\uac00", "\ud7a3"), split_up(x)).otherwise(x)), "")
    return F.when(F.translate(c, _ASCII, "") == "", c).otherwise(F.when(out.rlike("[\uac00-\ud7a3]"), korean).otherwise(out))


_ASCII = "".join(map(chr, range(0x80)))


def fold_letters(c: Column) -> Column:
    """The one-to-one part of the folding, inside the JVM."""
    return F.translate(c, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))


def _nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def tokens(c: Column, analyzer: str, **options) -> Column:
    """The token array of a string column; null gives an empty array."""
    c = F.coalesce(c, F.lit(""))
    if analyzer == "keyword":
        return _nonempty(F.array(c))
    if analyzer == "whitespace":
        return _nonempty(F.split(c, _NOT_SPACE))
    if analyzer == "normalizer":
        return _nonempty(F.array(F.lower(asciifold(c))))
    if analyzer == "norm":
        return _nonempty(F.split(asciifold(F.lower(c)), _SPLITS["norm"]))
    if analyzer == "search":
        return _nonempty(F.split(fold_letters(F.lower(c)), _SPLITS["standard"]))
    if analyzer == "edge_ngram":
        return edge_ngrams(_nonempty(F.split(_filtered(c, options.get("filters", ())), _SPLITS["standard"])), options.get("min", 2), options.get("max", 20))
    found = _nonempty(F.split(F.lower(c), _SPLITS[analyzer]))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if analyzer == "stop" else found


def _filtered(c: Column, filters) -> Column:
    for f in filters:
        c = F.lower(c) if f == "lowercase" else asciifold(c) if f == "asciifolding" else c
    return c


def edge_ngrams(words: Column, least: int, most: int) -> Column:
    """All prefixes of each token of ``least`` to ``most`` characters; none for impossible bounds."""
    if least < 1 or most < least:
        return F.array().cast("array<string>")
    long = F.filter(words, lambda w: F.length(w) >= least)
    return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(w))), lambda n: F.substring(w, F.lit(1), n))))


def _runs(keep: Callable[[str], bool], text: str) -> list[str]:
    return "".join(c if keep(c) else " " for c in text).split()


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _alnum(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def host_tokens(text: str, analyzer: str, **options) -> list[str]:
    """The same tokens of a single string, on the driver."""
    if analyzer == "keyword":
        return [text] if text else []
    if analyzer == "whitespace":
        return text.split()
    if analyzer == "normalizer":
        return [t] if (t := (fold(text) or "").lower()) else []
    if analyzer == "norm":
        return _runs(_alnum, fold(text.lower()))
    if analyzer == "search":
        return _runs(_alnum, text.lower().translate(str.maketrans(ONE_TO_ONE)))
    if analyzer == "standard":
        return _runs(_alnum, text.lower())
    if analyzer == "edge_ngram":
        for f in options.get("filters", ()):
            text = text.lower() if f == "lowercase" else fold(text) if f == "asciifolding" else text
        least, most = options.get("min", 2), options.get("max", 20)
        if least < 1 or most < least:
            return []
        return [w[:n] for w in _runs(_alnum, text) for n in range(least, min(most, len(w)) + 1)]
    found = _runs(_letter, text.lower())
    return [t for t in found if t not in STOP_WORDS] if analyzer == "stop" else found


def analyze(text: str | list[str], analyzer: str = "standard") -> list[dict]:
    """Tokens with byte offsets and positions, as an analysis request shows them."""
    if analyzer not in ("standard", "simple", "stop", "keyword", "whitespace"):
        raise ValueError(f"failed to find analyzer [{analyzer}]")
    keep = {"standard": _alnum, "simple": _letter, "stop": _letter, "whitespace": lambda c: not c.isspace(), "keyword": lambda c: True}[analyzer]
    out, position, base = [], 0, 0
    for t in [text] if isinstance(text, str) else text:
        at = 0
        for m in re.finditer(r"\x01+", "".join("\x01" if keep(c) else "\x00" for c in t), re.S):
            word = t[m.start() : m.end()]
            at = base + len(t[: m.start()].encode())
            token = word if analyzer in ("keyword", "whitespace") else word.lower()
            if not (analyzer == "stop" and token in STOP_WORDS):
                out.append({"token": token, "start_offset": at, "end_offset": at + len(word.encode()), "type": "word", "position": position})
            position += 1
        base += len(t.encode())
    return out
