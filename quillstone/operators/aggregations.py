"""Aggregations over a match set: terms, date_histogram, cardinality, composite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans.dsl import QueryError

KINDS = ("terms", "date_histogram", "cardinality", "composite")
# Names of calendar intervals.
INTERVALS = {"day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "year": "year", "1y": "year"}


def parse(body: dict) -> dict[str, tuple[str, dict]]:
    out = {}
    for name, spec in sorted((body or {}).items()):
        kinds = [k for k in spec if k in KINDS]
        if len(spec) != 1 or len(kinds) != 1:
            raise QueryError(f"unsupported aggregation [{name}]")
        kind, b = kinds[0], spec[kinds[0]]
        if kind == "composite":
            if not b.get("sources"):
                raise QueryError("[composite] needs sources")
        elif not isinstance(b.get("field"), str):
            raise QueryError(f"[{kind}] needs [field]")
        if kind == "date_histogram" and b.get("calendar_interval") not in INTERVALS:
            raise QueryError("unknown [calendar_interval]")
        size = b.get("size", 10)
        if isinstance(size, bool) or not isinstance(size, int) or size < 0:
            raise QueryError("[size] must not be negative")
        out[name] = (kind, b)
    return out


def _values(docs: DataFrame, c: Column, is_array: bool) -> DataFrame:
    """One row for each value; nulls skipped, every element of an array counts."""
    return docs.select((F.explode(c) if is_array else c).alias("key")).filter("key is not null")


def terms(docs: DataFrame, c: Column, is_array: bool = False, size: int = 10) -> DataFrame:
    """(key, doc_count): most frequent first, ties by key."""
    return _values(docs, c, is_array).groupBy("key").agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "key").limit(size)


def cardinality(docs: DataFrame, c: Column, is_array: bool = False) -> DataFrame:
    """One row: the exact number of distinct values."""
    return _values(docs, c, is_array).agg(F.count_distinct("key").alias("value"))


def bucket(c: Column, interval: str) -> Column:
    """The first day, as yyyyMMdd, of the interval that a yyyyMMdd string lies in; null if it is no date."""
    s = c.cast("string")
    ok = s.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$")
    kind = INTERVALS[interval]
    if kind == "year":
        out = F.concat(F.substring(s, 1, 4), F.lit("0101"))
    elif kind == "month":
        out = F.concat(F.substring(s, 1, 6), F.lit("01"))
    elif kind == "day":
        out = s
    else:
        day = F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd")))
        out = F.date_format(F.date_trunc("week", day), "yyyyMMdd")
    return F.when(ok, out)


def date_histogram(docs: DataFrame, c: Column, interval: str, is_array: bool = False) -> DataFrame:
    """(key, doc_count) in date order; gaps are not filled."""
    return _values(docs, c, is_array).select(bucket(F.col("key"), interval).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("doc_count")).orderBy("key")


def composite(docs: DataFrame, sources: list[tuple[str, Column]], size: int = 10, after: dict | None = None) -> DataFrame:
    """(names..., doc_count) in key order, strictly after a cursor.

    Keys of one source compare by kind (boolean, number, string, other), then as decimal strings. A cursor that lacks a source
    holds the largest key there.
    """
    names = [n for n, _ in sources]
    rows = docs.select(*[c.alias(n) for n, c in sources]).dropna(subset=names)
    ranks = {n: {T.BooleanType: 0, T.StringType: 2}.get(type(rows.schema[n].dataType), 1 if isinstance(rows.schema[n].dataType, T.NumericType) else 3) for n in names}
    out = rows.groupBy(*names).agg(F.count("*").alias("doc_count"))
    text = {n: F.col(n).cast("string") for n in names}
    if after is not None:
        tests, equal = [], F.lit(True)
        for n in names:
            v = after.get(n)
            rank, s = (3, "null") if v is None else (0, str(v).lower()) if isinstance(v, bool) else (1, str(v)) if isinstance(v, (int, float)) else (2, str(v))
            above = F.lit(ranks[n] > rank) | (F.lit(ranks[n] == rank) & (text[n] > s))
            tests.append(equal & above)
            equal = equal & F.lit(ranks[n] == rank) & (text[n] == s)
        out = out.filter(reduce(lambda a, b: a | b, tests))
    return out.orderBy(*[text[n] for n in names]).limit(size)


def run(docs: DataFrame, spec: dict[str, tuple[str, dict]], column, is_array) -> dict:
    """All aggregations of a request as a response body; ``column(field)`` gives a field's values."""
    out = {}
    for name, (kind, b) in spec.items():
        if kind == "terms":
            rows = terms(docs, column(b["field"]), is_array(b["field"]), b.get("size", 10)).collect()
            out[name] = {"buckets": [{"key": r["key"], "doc_count": r["doc_count"]} for r in rows]}
        elif kind == "cardinality":
            out[name] = {"value": cardinality(docs, column(b["field"]), is_array(b["field"])).first()["value"]}
        elif kind == "date_histogram":
            rows = date_histogram(docs, column(b["field"]), b["calendar_interval"], is_array(b["field"])).collect()
            extra = (lambda k: {"key_as_string": k}) if "format" in b else (lambda k: {})
            out[name] = {"buckets": [{"key": r["key"], **extra(r["key"]), "doc_count": r["doc_count"]} for r in rows]}
        else:
            sources = []
            for s in b["sources"]:
                (label, body), = s.items()
                (k, v), = body.items()
                c = column(v["field"])
                c = F.get(F.filter(c, lambda x: x.isNotNull()), 0) if is_array(v["field"]) else c
                sources.append((label, bucket(c, v["calendar_interval"]) if k == "date_histogram" else c))
            size = b.get("size", 10)
            rows = composite(docs, sources, size + 1, b.get("after")).collect()
            shown = [{"key": {n: r[n] for n, _ in sources}, "doc_count": r["doc_count"]} for r in rows[:size]]
            out[name] = {"buckets": shown, **({"after_key": shown[-1]["key"]} if len(rows) > size and shown else {})}
    return out
