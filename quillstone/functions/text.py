"""Scalar functions on terms: edit distance, fuzziness, wildcards, quantised lengths, BM25."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal-string-alignment distance (neighbouring characters may swap once); ``most + 1`` if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, last[j - 2] + 1)
            row.append(v)
        if min(row) > most and (i < 2 or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def near(t: Column, term: str, edits: int) -> Column:
    """A token lies within ``edits`` (up to two) of ``term``, swaps of neighbours included; no part is edited twice."""
    if edits == 0:
        return t == term
    plain = F.levenshtein(t, F.lit(term)) <= edits
    swap = lambda s, i: s[:i] + s[i + 1] + s[i] + s[i + 2 :]
    once = sorted({swap(term, i) for i in range(len(term) - 1)})
    if edits == 1:
        return plain | t.isin(once) if once else plain
    twice = sorted({swap(swap(term, i), j) for i in range(len(term) - 1) for j in range(i + 2, len(term) - 1)})
    out = plain | t.isin([*once, *twice]) if once else plain
    for i in range(len(term) - 1):  # one swap, and one edit before or after it
        before, middle, after = term[:i], term[i + 1] + term[i], term[i + 2 :]
        head, tail = before + middle, middle + after
        out = out | (t.startswith(head) & (F.levenshtein(F.substring(t, F.lit(len(head) + 1), F.length(t)), F.lit(after)) <= 1))
        out = out | (t.endswith(tail) & (F.levenshtein(F.substring(t, F.lit(1), F.length(t) - len(tail)), F.lit(before)) <= 1))
    return out


def within_edits(tokens: Column, term: str, edits: int) -> Column:
    """Some token lies within ``edits`` of ``term``."""
    if edits == 0:
        return F.array_contains(tokens, term)
    return F.exists(tokens, lambda t: F.length(t).between(len(term) - edits, len(term) + edits) & near(t, term, edits))


def fuzziness(value, length: int) -> int:
    """Allowed edits of a fuzziness setting for a term of so many characters."""
    if isinstance(value, bool):
        raise ValueError("fuzziness must be 0, 1, 2 or AUTO")
    s = str(value).upper()
    if s in ("0", "1", "2"):
        return int(s)
    m = re.fullmatch(r"AUTO(?::(\d+),(\d+))?", s)
    if not m or (m[1] and int(m[1]) > int(m[2])):
        raise ValueError(f"failed to parse fuzziness [{value}]")
    low, high = (int(m[1]), int(m[2])) if m[1] else (3, 6)
    return 0 if length < low else 1 if length < high else 2


def expand_fuzzy(dictionary, term: str, edits: int, prefix: int = 0, limit: int = 50):
    """Terms of a one-column DataFrame ``term`` near a term, nearest first, ties by the term."""
    t = F.col("term")
    found = dictionary.filter(F.substring(t, 1, prefix) == term[:prefix]) if prefix else dictionary
    found = found.filter(F.length(t).between(len(term) - edits, len(term) + edits)).distinct()
    least = F.coalesce(*[F.when(near(t, term, n), n) for n in range(edits + 1)])
    return found.withColumn("edits", least).filter(F.col("edits").isNotNull()).orderBy("edits", "term").limit(limit)


def wildcard_regex(pattern: str) -> str:
    """An anchored expression: ``*`` any characters, ``?`` one."""
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w])", r"\\\1", c) for c in pattern) + "$"


def quantised_length(dl: Column) -> Column:
    """A length as one byte keeps it: exact below 32, then the four leading bits of what exceeds 24."""
    w = dl - 24
    s = F.length(F.bin(w)) - 4
    return F.when(dl < 32, dl).otherwise(F.expr("24") + F.call_function("shiftleft", F.call_function("shiftright", w.cast("int"), s.cast("int")), s.cast("int")))


def quantise(dl: int) -> int:
    w = dl - 24
    return dl if w < 8 else 24 + ((w >> (s := w.bit_length() - 4)) << s)


def tf_idf(tf: Column) -> Column:
    """The older scorer's weight of a term: one and the logarithm of its frequency."""
    return 1 + F.log(tf)


def idf(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, weight: float, mean: float) -> Column:
    """``weight`` is the term's idf, times its count in the query."""
    return F.lit(weight) * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + B * dl / F.lit(mean)))
