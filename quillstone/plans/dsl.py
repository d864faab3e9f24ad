"""Parsing of JSON queries into small typed trees; every malformed query is a ``QueryError``."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from quillstone.functions import text as tx


class QueryError(ValueError):
    """A request that cannot be answered; ``status`` as a service would report it."""

    def __init__(self, reason: str, status: int = 400, kind: str = "parsing_exception"):
        super().__init__(reason)
        self.status, self.kind = status, kind

    def body(self) -> dict:
        return {"error": {"type": self.kind, "reason": str(self)}, "status": self.status}


@dataclass(frozen=True)
class Query:
    #: Whether hits carry a score.
    scoring = False


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class Match(Query):
    field: str
    text: str
    every: bool = False
    scoring = True


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    text: str
    scoring = True


@dataclass(frozen=True)
class Term(Query):
    field: str
    value: Any


@dataclass(frozen=True)
class Terms(Query):
    field: str
    values: tuple


@dataclass(frozen=True)
class Bool(Query):
    must: tuple = ()
    filter: tuple = ()
    must_not: tuple = ()
    should: tuple = ()
    least: int | str | None = None
    boost: float = 1.0
    scoring = True

    def required(self) -> int:
        """How many ``should`` clauses must match."""
        n, v = len(self.should), self.least
        if v is None:
            return 1 if n and not (self.must or self.filter or self.must_not) else 0
        if isinstance(v, str):
            raw = n * float(v[:-1]) / 100
            v = math.floor(raw) if raw >= 0 else math.floor(n + raw)
        elif v < 0:
            v = n + v
        return max(0, min(n, v))


@dataclass(frozen=True)
class MultiMatch(Query):
    text: str
    fields: tuple
    every: bool = False
    scoring = True


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    text: str
    edits: Any = 2
    scoring = True


@dataclass(frozen=True)
class Range(Query):
    field: str
    bounds: tuple  # of (gt|gte|lt|lte, value)


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    text: str


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    text: str


@dataclass(frozen=True)
class GeoDistance(Query):
    field: str
    metres: float
    point: tuple


@dataclass(frozen=True)
class GeoBox(Query):
    field: str
    top_left: tuple
    bottom_right: tuple


@dataclass(frozen=True)
class GeoPolygon(Query):
    field: str
    points: tuple


@dataclass(frozen=True)
class Function:
    """One scoring function: weight alone, a field's value, or decay of a date."""

    kind: str  # weight, field, gauss, exp, linear
    weight: float = 1.0
    filter: Query | None = None
    field: str = ""
    factor: float = 1.0
    modifier: str = "none"
    missing: float = 0.0
    origin: str = ""
    scale: float = 1.0
    decay: float = 0.5


@dataclass(frozen=True)
class FunctionScore(Query):
    query: Query = field(default_factory=MatchAll)
    functions: tuple = ()
    score_mode: str = "multiply"
    boost_mode: str = "multiply"
    boost: float = 1.0

    @property
    def scoring(self) -> bool:
        return self.query.scoring


# Metres in each unit of distance.
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "yards": 0.9144, "ft": 0.3048, "feet": 0.3048, "nm": 1852.0, "nmi": 1852.0}
MODES = ("multiply", "sum", "avg", "first", "min", "max")
BOOST_MODES = ("multiply", "sum", "avg", "replace", "min", "max")


def _one(body: dict, what: str) -> tuple[str, Any]:
    if not isinstance(body, dict) or len(body) != 1:
        raise QueryError(f"[{what}] needs exactly one key")
    return next(iter(body.items()))


def _number(x, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise QueryError(f"[{what}] must be a number")
    return float(x)


def _text(x, what: str) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    if not isinstance(x, str):
        raise QueryError(f"[{what}] must be a string, number or boolean")
    return x


def _every(x) -> bool:
    if str(x).lower() not in ("or", "and"):
        raise QueryError(f"operator must be [and] or [or], not [{x}]")
    return str(x).lower() == "and"


def point(x) -> tuple[float, float]:
    """(lat, lon) of an object, a "lat,lon" string or a [lon, lat] array."""
    if isinstance(x, dict) and set(x) == {"lat", "lon"}:
        lat, lon = x["lat"], x["lon"]
    elif isinstance(x, str) and re.fullmatch(r"\s*-?[\d.]+\s*,\s*-?[\d.]+\s*", x):
        lat, lon = map(float, x.split(","))
    elif isinstance(x, (list, tuple)) and len(x) == 2:
        lon, lat = x
    else:
        raise QueryError("failed to parse geo_point")
    lat, lon = _number(lat, "lat"), _number(lon, "lon")
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise QueryError("geo_point out of bounds")
    return lat, lon


def distance(x) -> float:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", str(x))
    unit = (m[2] or "m").lower() if m else ""
    if unit not in UNITS:
        raise QueryError(f"failed to parse distance [{x}]")
    return float(m[1]) * UNITS[unit]


def _clauses(x) -> tuple:
    return tuple(parse(q) for q in (x if isinstance(x, list) else [x]))


def parse(body: dict) -> Query:
    kind, b = _one(body, "query")
    if kind not in _PARSERS:
        raise QueryError(f"unknown query [{kind}]")
    if kind != "match_all" and not isinstance(b, dict):
        raise QueryError(f"[{kind}] must be an object")
    return _PARSERS[kind](b)


def _match_all(b) -> Query:
    if not isinstance(b, dict) or set(b) - {"boost"}:
        raise QueryError("[match_all] takes only [boost]")
    return MatchAll(_number(b.get("boost", 1.0), "boost"))


def _match(b) -> Query:
    f, v = _one(b, "match")
    if not isinstance(v, dict):
        return Match(f, _text(v, "match"))
    if "query" not in v or set(v) - {"query", "operator", "fuzziness"}:
        raise QueryError("[match] takes [query], [operator] and [fuzziness]")
    if "fuzziness" in v:
        return _fuzzy({f: {"value": v["query"], "fuzziness": v["fuzziness"]}})
    return Match(f, _text(v["query"], "match"), _every(v.get("operator", "or")))


def _phrase(b) -> Query:
    f, v = _one(b, "match_phrase")
    return Phrase(f, _text(v.get("query") if isinstance(v, dict) else v, "match_phrase"))


def _term(b) -> Query:
    f, v = _one(b, "term")
    return Term(f, _text(v.get("value") if isinstance(v, dict) else v, "term"))


def _terms(b) -> Query:
    f, v = _one(b, "terms")
    if not isinstance(v, list) or not v:
        raise QueryError("[terms] needs a non-empty array")
    return Terms(f, tuple(_text(x, "terms") for x in v))


def _bool(b) -> Query:
    if not b or set(b) - {"must", "filter", "must_not", "should", "minimum_should_match", "boost"}:
        raise QueryError("[bool] needs clauses, and takes no other keys")
    least = b.get("minimum_should_match")
    if isinstance(least, str):
        if re.fullmatch(r"-?\d+", least):
            least = int(least)
        elif not re.fullmatch(r"-?\d+(\.\d+)?%", least):
            raise QueryError("failed to parse [minimum_should_match]")
    elif least is not None and (isinstance(least, bool) or not isinstance(least, int)):
        raise QueryError("failed to parse [minimum_should_match]")
    parts = {k: _clauses(b[k]) for k in ("must", "filter", "must_not", "should") if k in b}
    if not any(parts.values()):
        raise QueryError("[bool] needs clauses")
    return Bool(**parts, least=least, boost=_number(b.get("boost", 1.0), "boost"))


def _multi_match(b) -> Query:
    fields = b.get("fields")
    if "query" not in b or not isinstance(fields, list) or not fields or not all(isinstance(f, str) for f in fields):
        raise QueryError("[multi_match] needs [query] and [fields]")
    if any("^" in f for f in fields):
        raise QueryError("[multi_match] fields take no boost")
    return MultiMatch(_text(b["query"], "query"), tuple(fields), _every(b.get("operator", "or")))


def _fuzzy(b) -> Query:
    f, v = _one(b, "fuzzy")
    value, edits = (v.get("value"), v.get("fuzziness", 2)) if isinstance(v, dict) else (v, 2)
    try:
        tx.fuzziness(edits, 1)
    except ValueError as e:
        raise QueryError(str(e)) from None
    return Fuzzy(f, _text(value, "fuzzy"), edits)


def _range(b) -> Query:
    f, v = _one(b, "range")
    if not isinstance(v, dict) or set(v) - {"gt", "gte", "lt", "lte", "boost", "format", "relation", "time_zone"}:
        raise QueryError("[range] takes bounds")
    bounds = tuple((k, v[k]) for k in ("gt", "gte", "lt", "lte") if v.get(k) is not None)
    if not bounds:
        raise QueryError("[range] needs a bound")
    return Range(f, bounds)


def _exists(b) -> Query:
    if set(b) != {"field"} or not isinstance(b["field"], str):
        raise QueryError("[exists] needs [field]")
    return Exists(b["field"])


def _pattern(kind: str, cls):
    def build(b) -> Query:
        f, v = _one(b, kind)
        s = _text(v.get("value") if isinstance(v, dict) else v, kind)
        if not s:
            raise QueryError(f"[{kind}] must not be empty")
        return cls(f, s)

    return build


def _geo_distance(b) -> Query:
    rest = {k: v for k, v in b.items() if k not in ("distance", "distance_type", "validation_method")}
    if "distance" not in b:
        raise QueryError("[geo_distance] needs [distance]")
    f, v = _one(rest, "geo_distance")
    return GeoDistance(f, distance(b["distance"]), point(v))


def _geo_box(b) -> Query:
    f, v = _one({k: x for k, x in b.items() if k != "validation_method"}, "geo_bounding_box")
    if not isinstance(v, dict) or set(v) != {"top_left", "bottom_right"}:
        raise QueryError("[geo_bounding_box] needs [top_left] and [bottom_right]")
    return GeoBox(f, point(v["top_left"]), point(v["bottom_right"]))


def _geo_polygon(b) -> Query:
    f, v = _one({k: x for k, x in b.items() if k != "validation_method"}, "geo_polygon")
    points = v.get("points") if isinstance(v, dict) else None
    if not isinstance(points, list) or len(points) < 3:
        raise QueryError("[geo_polygon] needs three points or more")
    return GeoPolygon(f, tuple(map(point, points)))


def _function(b: dict) -> Function:
    if not isinstance(b, dict):
        raise QueryError("a function must be an object")
    kinds = [k for k in b if k not in ("filter", "weight")]
    weight = _number(b.get("weight", 1.0), "weight")
    if weight < 0:
        raise QueryError("[weight] must not be negative")
    only = parse(b["filter"]) if "filter" in b else None
    if not kinds:
        if "weight" not in b:
            raise QueryError("a function needs a kind or a weight")
        return Function("weight", weight, only)
    if len(kinds) > 1:
        raise QueryError("a function has one kind")
    kind, v = kinds[0], b[kinds[0]]
    if kind == "field_value_factor":
        if not isinstance(v, dict) or not isinstance(v.get("field"), str):
            raise QueryError("[field_value_factor] needs [field]")
        if v.get("modifier", "none") not in ("none", "log1p", "sqrt", "reciprocal"):
            raise QueryError("unknown modifier")
        return Function("field", weight, only, v["field"], _number(v.get("factor", 1.0), "factor"), v.get("modifier", "none"), _number(v.get("missing", 0.0), "missing"))
    if kind in ("gauss", "exp", "linear"):
        f, d = _one(v, kind)
        if not isinstance(d, dict):
            raise QueryError(f"failed to parse [{kind}]")
        scale = re.fullmatch(r"(\d+(?:\.\d+)?)d?", str(d.get("scale", "")))
        decay = _number(d.get("decay", 0.5), "decay")
        if not scale or float(scale[1]) <= 0 or not 0 < decay < 1 or not re.fullmatch(r"\d{8}", str(d.get("origin", ""))) or str(d.get("offset", "0")) not in ("0", "0d"):
            raise QueryError(f"failed to parse [{kind}]")
        return Function(kind, weight, only, f, origin=str(d["origin"]), scale=float(scale[1]), decay=decay)
    raise QueryError(f"unsupported function [{kind}]")


def _function_score(b) -> Query:
    modes = b.get("score_mode", "multiply"), b.get("boost_mode", "multiply")
    if modes[0] not in MODES or modes[1] not in BOOST_MODES:
        raise QueryError("unknown mode")
    listed = b.get("functions")
    if listed is None:
        own = {k: v for k, v in b.items() if k in ("weight", "field_value_factor", "gauss", "exp", "linear", "script_score", "random_score")}
        listed = [own] if own else []
    return FunctionScore(
        parse(b["query"]) if "query" in b else MatchAll(), tuple(map(_function, listed)), *modes, _number(b.get("boost", 1.0), "boost")
    )


_PARSERS = {
    "match_all": _match_all, "match": _match, "match_phrase": _phrase, "term": _term, "terms": _terms, "bool": _bool, "multi_match": _multi_match,
    "fuzzy": _fuzzy, "range": _range, "exists": _exists, "prefix": _pattern("prefix", Prefix), "wildcard": _pattern("wildcard", Wildcard),
    "geo_distance": _geo_distance, "geo_bounding_box": _geo_box, "geo_polygon": _geo_polygon, "function_score": _function_score,
}
