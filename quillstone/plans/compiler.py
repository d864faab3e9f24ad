"""Query trees to Columns: a boolean for matching, a double for scoring, and the statistics in between.

A search is two passes without a shuffle: one row of aggregates (documents, lengths and document
frequencies of the query's terms), then filter, score and top-k with those statistics as literals.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import analysis as an
from quillstone.functions import text as tx

from . import dsl
from .mapping import Mapping

EARTH = 6_371_008.8
NUMBERS = ("integer", "long", "short", "byte", "float", "double")
#: Names of the columns with a field's tokens, as indexed and as the search-side tokenizer gives them.
TOKENS, LOOSE = "__tokens:{}", "__loose:{}"
#: Names of the columns with a field's length and with how often it has a term.
LENGTH, COUNT = "__length:{}", "__count:{}:{}"


@dataclass
class Statistics:
    """For each field: documents with a token, mean length, and document frequency of each term."""

    fields: dict[str, tuple[int, float]] = field(default_factory=dict)
    df: dict[tuple[str, str], int] = field(default_factory=dict)


class Compiler:
    def __init__(self, mapping: Mapping, schema: T.StructType, now: dt.date | None = None):
        self.mapping, self.schema = mapping, schema
        self.now = now or dt.datetime.now(dt.UTC).date()

    # ------------------------------------------------------------ fields

    def source(self, name: str) -> str:
        """The stored column behind a field or a multi-field."""
        return name if name in self.schema.fieldNames() else name.rpartition(".")[0] or name

    def known(self, name: str) -> bool:
        return self.source(name) in self.schema.fieldNames()

    def col(self, name: str) -> Column:
        return F.col(f"`{self.source(name)}`") if self.known(name) else F.lit(None).cast("string")

    def is_array(self, name: str) -> bool:
        return self.known(name) and isinstance(self.schema[self.source(name)].dataType, T.ArrayType)

    def tokens(self, name: str) -> Column:
        """A field's tokens as indexed, from a stored token column if there is one."""
        stored = TOKENS.format(name)
        if stored in self.schema.fieldNames():
            return F.col(f"`{stored}`")
        kind, options = self.mapping.analyzer(name) or ("simple", {})
        return self._tokens(name, kind, options)

    def _tokens(self, name: str, kind: str, options: dict | None = None) -> Column:
        c = self.col(name)
        if self.is_array(name):
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(self.schema[self.source(name)].dataType)), lambda x: an.tokens(x.cast("string"), kind, **(options or {}))))
        return an.tokens(c.cast("string"), kind, **(options or {}))

    def loose(self, name: str) -> Column:
        """Search-side tokens, as prefixes, wildcards and fuzzy terms see them."""
        stored = LOOSE.format(name)
        return F.col(f"`{stored}`") if stored in self.schema.fieldNames() else self._tokens(name, "search")

    def prepared(self, docs: DataFrame, q: dsl.Query, scores_only: bool = False) -> tuple[DataFrame, Compiler]:
        """``docs`` with the token columns that a query needs, made once a row, and the compiler that reads them.

        They pass through a one-row ``explode``: else the optimiser would put the tokenizer's expression back into every
        predicate and every term's count. Predicates on other columns still go below it.
        """
        wanted: dict[str, Column] = {}

        def need(form: str, f: str) -> None:
            if self.known(f) and form.format(f) not in self.schema.fieldNames():
                wanted[form.format(f)] = (self.tokens if form == TOKENS else self.loose)(f)

        def walk(x) -> None:
            if isinstance(x, (dsl.Match, dsl.Phrase, dsl.Term, dsl.Terms)):
                if self.plain_keyword(x.field) is None:
                    need(TOKENS, x.field)
            elif isinstance(x, dsl.MultiMatch):
                for f in x.fields:
                    need(TOKENS, f)
            elif isinstance(x, (dsl.Fuzzy, dsl.Prefix, dsl.Wildcard)):
                need(LOOSE, x.field)
                need(TOKENS, x.field)
            elif isinstance(x, dsl.Bool):
                for c in (*x.must, *x.filter, *x.must_not, *x.should):
                    walk(c)
            elif isinstance(x, dsl.FunctionScore):
                walk(x.query)
                for f in x.functions:
                    if f.filter:
                        walk(f.filter)

        if scores_only:
            for f in self.scored_terms(q):
                need(TOKENS, f)
        else:
            walk(q)
        if not wanted:
            return docs, self
        one = docs.withColumn("__made", F.explode(F.array(F.struct(*[c.alias(n) for n, c in wanted.items()]))))
        out = one.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col("__made")[n].alias(n) for n in wanted])
        return out, Compiler(self.mapping, out.schema, self.now)

    def query_tokens(self, name: str, text: str) -> list[str]:
        found = self.mapping.analyzer(name, query=True)
        return an.host_tokens(text, found[0], **found[1]) if found else []

    # ------------------------------------------------------------ matching

    def match(self, q: dsl.Query) -> Column:
        return F.coalesce(getattr(self, "_m_" + type(q).__name__)(q), F.lit(False))

    def _m_MatchAll(self, q) -> Column:
        return F.lit(True)

    def predicate(self, q: dsl.Query) -> Column:
        """As ``match``, for a filter: null there is false, so conjunctions stay apart and simple ones reach the scan."""
        if isinstance(q, dsl.Bool):
            return self._m_Bool(q, self.predicate)
        return getattr(self, "_m_" + type(q).__name__)(q)

    def plain_keyword(self, name: str) -> Column | None:
        """The column itself if its only token is its whole value."""
        if not self.known(name) or self.is_array(name) or self.source(name) != name:
            return None
        return self.col(name) if (self.mapping.analyzer(name) or ("", {}))[0] == "keyword" and isinstance(self.schema[name].dataType, T.StringType) else None

    def counted(self, docs: DataFrame, q: dsl.Query, stats: Statistics) -> tuple[DataFrame, Compiler]:
        """``docs`` with the lengths and term counts that a score needs, taken once a row, in the way of ``prepared``."""
        wanted: dict[str, Column] = {}
        for f, terms in self.scored_terms(q).items():
            if f in stats.fields:
                wanted[LENGTH.format(f)] = F.size(self.tokens(f))
                wanted |= {COUNT.format(f, w): F.size(F.filter(self.tokens(f), _equals(w))) for w in sorted(terms) if stats.df.get((f, w))}
        if not wanted:
            return docs, self
        names = {f"c{k}": n for k, n in enumerate(wanted)}
        one = docs.withColumn("__counts", F.explode(F.array(F.struct(*[wanted[n].alias(k) for k, n in names.items()]))))
        out = one.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col("__counts")[k].alias(n) for k, n in names.items()])
        return out, Compiler(self.mapping, out.schema, self.now)

    def _some(self, name: str, words: list[str], every: bool) -> Column:
        if not words:
            return F.lit(False)
        words = list(dict.fromkeys(words))
        whole = self.plain_keyword(name)
        if whole is not None:
            return (whole == words[0]) if len(words) == 1 else F.lit(False) if every else whole.isin(words)
        toks = self.tokens(name)
        if every:
            return reduce(lambda a, b: a & b, [F.array_contains(toks, w) for w in words])
        return F.arrays_overlap(toks, F.array(*map(F.lit, words)))

    def _m_Match(self, q) -> Column:
        return self._some(q.field, self.query_tokens(q.field, q.text), q.every)

    def _m_Phrase(self, q) -> Column:
        words = self.query_tokens(q.field, q.text)
        if not words:
            return F.lit(False)
        # No token holds the separator, so a run of tokens is a part of the joined string.
        line = F.concat(F.lit("\x01"), F.array_join(self.tokens(q.field), "\x01"), F.lit("\x01"))
        return F.contains(line, F.lit("\x01" + "\x01".join(words) + "\x01"))

    def _m_Term(self, q) -> Column:
        return self._some(q.field, self.query_tokens(q.field, q.value)[:1], False)

    def _m_Terms(self, q) -> Column:
        return self._some(q.field, [w for v in q.values for w in self.query_tokens(q.field, v)[:1]], False)

    #: Cheap clauses first: the JVM stops at the first that fails.
    _COST = {"Range": 0, "Exists": 0, "Term": 1, "Terms": 1, "GeoBox": 1, "Match": 2, "MultiMatch": 3, "Phrase": 3, "Prefix": 4, "Wildcard": 4, "Fuzzy": 9}

    def _m_Bool(self, q, inner=None) -> Column:
        cost, inner = lambda c: self._COST.get(type(c).__name__, 5), inner or self.match
        needed = sorted((*q.must, *q.filter), key=cost)
        parts = [inner(c) for c in needed] + [~self.match(c) for c in sorted(q.must_not, key=cost)]
        parts += [p for c in needed if isinstance(c, dsl.Prefix) and (p := self._prefix_terms(c)) is not None]
        n, least = len(q.should), q.required()
        if n and least:
            should = [self.match(c) for c in q.should]
            if least == n:
                parts += should
            elif least == 1:
                parts.append(reduce(lambda a, b: a | b, should))
            else:
                parts.append(reduce(lambda a, b: a + b, [s.cast("int") for s in should]) >= least)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _m_MultiMatch(self, q) -> Column:
        return reduce(lambda a, b: a | b, [self._some(f, self.query_tokens(f, q.text), q.every) for f in q.fields])

    def _m_Fuzzy(self, q) -> Column:
        words = an.host_tokens(q.text, "search")
        toks = self.loose(q.field)
        return reduce(lambda a, b: a & b, [tx.within_edits(toks, w, tx.fuzziness(q.edits, len(w))) for w in words]) if words else F.lit(False)

    def _m_Range(self, q) -> Column:
        f = self.mapping.get(q.field)
        c = self.col(q.field)
        if f and f.type == "date":
            days = [(op, self.day(v, f.format)) for op, v in q.bounds]
            if any(d is None for _, d in days):
                return F.lit(False)
            value = self.day_column(c, f.format)
            inside = reduce(lambda a, b: a & b, [self._compare(value, op, F.lit(d)) for op, d in days])
            return F.when(value.isNotNull(), inside).otherwise(self._plain_range(c.cast("string"), q.bounds, False))
        kind = self.schema[self.source(q.field)].dataType if self.known(q.field) else T.StringType()
        numeric = isinstance(kind, T.NumericType)
        if isinstance(kind, T.IntegralType) and all(isinstance(v, int) and abs(v) < 1 << 31 for _, v in q.bounds if isinstance(v, (int, float))):
            return self._plain_range(c, q.bounds, True, int)  # without a cast, so that it reaches the scan
        return self._plain_range(c.cast("double") if numeric else c.cast("string"), q.bounds, numeric)

    def _plain_range(self, c: Column, bounds, numeric: bool, number=float) -> Column:
        """A bound of the other kind does not restrict; null values match nothing."""
        usable = [(op, v) for op, v in bounds if isinstance(v, (int, float)) == numeric]
        return reduce(lambda a, b: a & b, [self._compare(c, op, F.lit(number(v) if numeric else v)) for op, v in usable], c.isNotNull())

    @staticmethod
    def _compare(a: Column, op: str, b: Column) -> Column:
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]

    def day(self, v, fmt: str = "yyyyMMdd") -> dt.date | None:
        """The day of a bound: a date, or now with offsets such as ``now-1M/d``."""
        s = str(v)
        m = re.fullmatch(r"now((?:[+-]\d+[yMwd])*)(/d)?", s)
        if m:
            day = self.now
            for sign, n, unit in re.findall(r"([+-])(\d+)([yMwd])", m[1]):
                n = int(sign + n)
                if unit in "yM":
                    months = day.year * 12 + day.month - 1 + n * (12 if unit == "y" else 1)
                    year, month = divmod(months, 12)
                    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
                    day = dt.date(year, month + 1, min(day.day, last))
                else:
                    day += dt.timedelta(days=n * (7 if unit == "w" else 1))
            return day
        try:
            first = fmt.split("||")[0]
            if first in ("epoch_millis", "epoch_second"):
                return dt.datetime.fromtimestamp(int(s) / (1000 if first == "epoch_millis" else 1), dt.UTC).date()
            return dt.datetime.strptime(s, "%Y%m%d").date() if re.fullmatch(r"\d{8}", s) else None
        except (ValueError, OverflowError):
            return None

    @staticmethod
    def day_column(c: Column, fmt: str = "yyyyMMdd") -> Column:
        first = fmt.split("||")[0]
        if first in ("epoch_millis", "epoch_second"):
            return F.to_date(F.timestamp_seconds(c.cast("double") / (1000 if first == "epoch_millis" else 1)))
        s = c.cast("string")
        return F.when(s.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd"))))

    def _m_Exists(self, q) -> Column:
        if not self.known(q.field):
            return F.lit(False)
        c = self.col(q.field)
        if self.is_array(q.field):
            return c.isNotNull() & (F.size(c) > 0)
        return c.isNotNull() & (c != "") if isinstance(self.schema[self.source(q.field)].dataType, T.StringType) else c.isNotNull()

    def _m_Prefix(self, q) -> Column:
        start = "".join(an.host_tokens(q.text, "search")[:1]) or q.text.lower()
        return F.exists(self.loose(q.field), lambda t: t.startswith(start))

    def _prefix_terms(self, q) -> Column | None:
        """What a required prefix asks of the indexed terms besides: of keyword and date fields that the whole value begins so,
        of fields with stored prefixes of that length that a term does."""
        f, start = self.mapping.get(q.field), "".join(self.query_tokens(q.field, q.text)[:1])
        if not f or not start or not self.known(q.field):
            return None
        if f.prefixes:
            return F.exists(self.tokens(q.field), lambda t: t.startswith(start)) if f.prefixes[0] <= len(start) <= f.prefixes[1] else None
        if f.type not in ("keyword", "date"):
            return None
        whole = self.plain_keyword(q.field)
        return whole.startswith(start) if whole is not None else F.exists(self.tokens(q.field), lambda t: t.startswith(start))

    def _m_Wildcard(self, q) -> Column:
        pattern = tx.wildcard_regex(q.text.lower().translate(str.maketrans(an.ONE_TO_ONE)))
        return F.exists(self.loose(q.field), lambda t: t.rlike(pattern))

    def _point(self, name: str) -> tuple[Column, Column]:
        """(lat, lon) of a struct, a "lat,lon" string or a [lon, lat] array column; null out of bounds."""
        c, t = self.col(name), self.schema[self.source(name)].dataType if self.known(name) else T.StringType()
        if isinstance(t, T.StructType):
            lat, lon = c["lat"].cast("double"), c["lon"].cast("double")
        elif isinstance(t, T.ArrayType):
            lat, lon = F.try_element_at(c, F.lit(2)).cast("double"), F.try_element_at(c, F.lit(1)).cast("double")
        else:
            parts = F.split(c, ",")
            lat, lon = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
        ok = lat.between(-90, 90) & lon.between(-180, 180)
        return F.when(ok, lat), F.when(ok, lon)

    def _m_GeoDistance(self, q) -> Column:
        lat, lon = self._point(q.field)
        return haversine(lat, lon, *q.point) <= q.metres

    def _m_GeoBox(self, q) -> Column:
        lat, lon = self._point(q.field)
        return lat.between(q.bottom_right[0], q.top_left[0]) & lon.between(q.top_left[1], q.bottom_right[1])

    def _m_GeoPolygon(self, q) -> Column:
        lat, lon = self._point(q.field)
        inside = F.lit(False)
        for (a_lat, a_lon), (b_lat, b_lon) in zip(q.points, q.points[1:] + q.points[:1]):
            if a_lat != b_lat:
                crosses = ((F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)) & (lon < F.lit(b_lon - a_lon) * (lat - a_lat) / F.lit(b_lat - a_lat) + a_lon)
                inside = inside != crosses
        return inside

    def _m_FunctionScore(self, q) -> Column:
        return self.match(q.query)

    # ------------------------------------------------------------ statistics

    def scored_terms(self, q: dsl.Query) -> dict[str, set[str]]:
        """field -> analyzed terms that some score needs."""
        out: dict[str, set[str]] = {}

        def walk(x) -> None:
            if isinstance(x, (dsl.Match, dsl.Phrase, dsl.Fuzzy)):
                out.setdefault(x.field, set()).update(self.query_tokens(x.field, x.text))
            elif isinstance(x, dsl.MultiMatch):
                for f in x.fields:
                    out.setdefault(f, set()).update(self.query_tokens(f, x.text))
            elif isinstance(x, dsl.Bool):
                for c in (*x.must, *x.should):
                    walk(c)
            elif isinstance(x, dsl.FunctionScore):
                walk(x.query)

        walk(q)
        return {f: t for f, t in out.items() if f in self.mapping.fields or self.source(f) == f}

    def statistics(self, docs: DataFrame, q: dsl.Query) -> Statistics:
        """One aggregate row over the index."""
        wanted = {f: sorted(t) for f, t in self.scored_terms(q).items() if t and self.known(f)}
        if not wanted:
            return Statistics()
        aggs = []
        docs, made = self.prepared(docs, q, scores_only=True)
        prepared = docs.select(*[made.tokens(f).alias(f"t{i}") for i, f in enumerate(wanted)])
        for i, terms in enumerate(wanted.values()):
            t = F.col(f"t{i}")
            aggs += [F.count_if(F.size(t) > 0).alias(f"n{i}"), F.sum(F.size(t)).alias(f"s{i}")]
            aggs += [F.count_if(F.array_contains(t, w)).alias(f"d{i}_{j}") for j, w in enumerate(terms)]
        row = prepared.agg(*aggs).first()
        out = Statistics()
        for i, (f, terms) in enumerate(wanted.items()):
            n, total = row[f"n{i}"], row[f"s{i}"] or 0
            norms = getattr(self.mapping.get(f), "norms", True)
            out.fields[f] = (n, (total / n if n else 0.0) if norms else 0.0)
            out.df |= {(f, w): row[f"d{i}_{j}"] for j, w in enumerate(terms)}
        return out

    # ------------------------------------------------------------ scoring

    def bm25(self, name: str, words: list[str], stats: Statistics) -> Column | None:
        """Sum over distinct terms, in term order; None without statistics."""
        if name not in stats.fields or not words:
            return None
        n, mean = stats.fields[name]
        toks, have = self.tokens(name), set(self.schema.fieldNames())
        taken = lambda column, otherwise: F.col(f"`{column}`") if column in have else otherwise
        dl = tx.quantised_length(taken(LENGTH.format(name), F.size(toks))) if mean else F.lit(1)
        total = None
        for w, times in sorted(Counter(words).items()):
            df = stats.df.get((name, w), 0)
            if not 0 < df <= n:
                continue
            tf = taken(COUNT.format(name, w), F.size(F.filter(toks, _equals(w))))
            part = F.when(tf > 0, tx.bm25(tf, dl, tx.idf(n, df) * times, mean or 1.0)).otherwise(0.0)
            total = part if total is None else total + part
        return F.lit(0.0) if total is None else total

    def score(self, q: dsl.Query, stats: Statistics) -> Column:
        """A clause's score; it does not look at whether the clause matched."""
        if isinstance(q, (dsl.Match, dsl.Phrase, dsl.Fuzzy)):
            s = self.bm25(q.field, self.query_tokens(q.field, q.text), stats)
            return F.lit(1.0) if s is None else F.when(s > 0, s).otherwise(1.0)
        if isinstance(q, dsl.MultiMatch):
            parts = [s for f in q.fields if (s := self.bm25(f, self.query_tokens(f, q.text), stats)) is not None]
            return F.greatest(F.lit(1e-9), *parts) if parts else F.lit(1.0)
        if isinstance(q, dsl.Bool):
            total = F.lit(0.0)
            for c in q.must:
                total = total + self.score(c, stats)
            for c in q.should:
                s = self.score(c, stats)
                total = total + F.when(s == 1.0, 0.0).otherwise(s)
            return F.when(total > 0, total).otherwise(1.0) * q.boost
        if isinstance(q, dsl.FunctionScore):
            return self._function_score(q, stats)
        return F.lit(q.boost) if isinstance(q, dsl.MatchAll) else F.lit(1.0)

    def _function_score(self, q: dsl.FunctionScore, stats: Statistics) -> Column:
        base = self.score(q.query, stats)
        if not q.functions:
            return base * q.boost
        on = [self.match(f.filter) if f.filter else F.lit(True) for f in q.functions]
        values = [self._function(f) for f in q.functions]
        if q.score_mode == "multiply":
            mixed = reduce(lambda a, b: a * b, [F.when(o, v).otherwise(1.0) for o, v in zip(on, values)])
        elif q.score_mode in ("sum", "avg"):
            mixed = reduce(lambda a, b: a + b, [F.when(o, v).otherwise(0.0) for o, v in zip(on, values)])
            mixed = mixed / float(len(values)) if q.score_mode == "avg" else mixed
        else:
            kept = [F.when(o, v) for o, v in zip(on, values)]
            if q.score_mode == "first" or len(kept) == 1:
                mixed = F.coalesce(*kept, F.lit(1.0))
            else:
                mixed = F.coalesce((F.least if q.score_mode == "min" else F.greatest)(*kept), F.lit(1.0))
        out = {
            "multiply": base * mixed, "sum": base + mixed, "avg": (base + mixed) / 2, "replace": mixed, "min": F.least(base, mixed), "max": F.greatest(base, mixed),
        }[q.boost_mode]
        return out * q.boost

    def _function(self, f: dsl.Function) -> Column:
        if f.kind == "weight":
            return F.lit(f.weight)
        if f.kind == "field":
            v = F.coalesce(self.col(f.field).cast("string").try_cast("double"), F.lit(f.missing)) * f.factor
            v = {
                "none": v, "log1p": F.log(1 + v), "sqrt": F.when(v < 0, 0.0).otherwise(F.sqrt(v)), "reciprocal": F.when(v == 0, 0.0).otherwise(1 / v),
            }[f.modifier]
            return v * f.weight
        day = self.day_column(self.col(f.field))
        d = F.abs(F.datediff(day, F.lit(self.day(f.origin)))).cast("double")
        log = F.log(F.lit(1 / f.decay))
        v = {
            "gauss": F.exp(-d * d * log / (f.scale * f.scale)), "exp": F.exp(-d * log / f.scale), "linear": F.greatest(F.lit(0.0), 1 - d * (1 - f.decay) / f.scale),
        }[f.kind]
        return F.coalesce(v, F.lit(f.decay)) * f.weight


def _equals(word: str):
    return lambda x: x == word


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
