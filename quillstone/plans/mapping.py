"""Index mappings: field types, analyzers, dynamic inference, additive merges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .dsl import QueryError

# Field types with their aliases.
TYPES = {
    "text": "text", "keyword": "keyword", "integer": "integer", "int": "integer", "long": "long", "short": "short", "byte": "byte", "float": "float",
    "double": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "geo_point": "geo_point", "object": "object", "array": "array", "unknown": "unknown",
}
BUILTIN = ("standard", "simple", "whitespace", "keyword", "stop", "norm")
NORMALIZERS = ("norm", "lowercase", "asciifolding")


class MappingError(QueryError):
    def __init__(self, reason: str):
        super().__init__(reason, 400, "mapper_parsing_exception")


@dataclass(frozen=True)
class Field:
    type: str
    analyzer: str | None = None
    search_analyzer: str | None = None
    normalizer: str | None = None
    norms: bool = True
    format: str = "yyyyMMdd"
    prefixes: tuple[int, int] | None = None
    fields: dict[str, Field] = field(default_factory=dict)

    def index_analyzer(self) -> str:
        if self.normalizer:
            return "normalizer"
        return self.analyzer or ("simple" if self.type == "text" else "keyword")


@dataclass
class Mapping:
    fields: dict[str, Field] = field(default_factory=dict)
    #: Custom analyzers: name -> options of an edge n-gram analyzer.
    custom: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def parse(cls, body: dict | None, settings: dict | None = None) -> Mapping:
        body = body or {}
        props = (body.get("_doc") or body).get("properties", {})
        out = cls(custom=_custom_analyzers((settings or {}).get("analysis") or {}))
        out.fields = {name: out._field(name, spec) for name, spec in props.items()}
        return out

    def _field(self, name: str, spec: dict, nested: bool = False) -> Field:
        kind = TYPES.get(spec.get("type", "object" if "properties" in spec else ""))
        if kind is None:
            raise MappingError(f"No handler for type [{spec.get('type')}] declared on field [{name}]")
        for k in ("analyzer", "search_analyzer"):
            if k in spec and kind != "text":
                raise MappingError(f"[{k}] is only for text fields, not [{name}]")
        if "format" in spec and kind != "date":
            raise MappingError(f"[format] is only for date fields, not [{name}]")
        if spec.get("normalizer") not in (None, *NORMALIZERS):
            raise MappingError(f"normalizer [{spec['normalizer']}] not found for field [{name}]")
        prefixes = None
        if "index_prefixes" in spec:
            least, most = spec["index_prefixes"].get("min_chars", 2), spec["index_prefixes"].get("max_chars", 5)
            if kind != "text" or not 2 <= least < most <= 20:
                raise MappingError(f"bad [index_prefixes] on field [{name}]")
            prefixes = (least, most)
        if nested and "fields" in spec:
            raise MappingError(f"multi-fields of [{name}] have one level")
        subs = {k: self._field(f"{name}.{k}", v, True) for k, v in spec.get("fields", {}).items()}
        return Field(kind, spec.get("analyzer"), spec.get("search_analyzer"), spec.get("normalizer"), spec.get("norms", kind == "text"), spec.get("format", "yyyyMMdd"), prefixes, subs)

    def get(self, name: str) -> Field | None:
        if name in self.fields:
            return self.fields[name]
        base, _, sub = name.rpartition(".")
        return self.fields[base].fields.get(sub) if base in self.fields else None

    def analyzer(self, name: str, query: bool = False) -> tuple[str, dict] | None:
        """(analyzer, options) of a field; None for a name that does not resolve at query time (it matches nothing)."""
        f = self.get(name) or Field("text")
        wanted = (f.search_analyzer or f.analyzer) if query else f.analyzer
        if wanted is None or f.normalizer:
            return f.index_analyzer(), {}
        if wanted in BUILTIN:
            return wanted, {}
        if wanted in self.custom:
            return "edge_ngram", self.custom[wanted]
        return None if query else ("simple", {})

    def merge(self, other: Mapping) -> Mapping:
        out = dict(self.fields)
        for name, f in other.fields.items():
            have = out.get(name)
            if have and have.type != f.type:
                raise MappingError(f"mapper [{name}] of different type, current_type [{have.type}], merged_type [{f.type}]")
            out[name] = replace(f, fields={**(have.fields if have else {}), **f.fields})
        return Mapping(out, {**self.custom, **other.custom})

    def infer(self, schema: T.StructType) -> Mapping:
        """Adds fields that a DataFrame has and the mapping lacks."""
        return Mapping({**{f.name: Field(_inferred(f.dataType)) for f in schema.fields if not f.name.startswith("_")}, **self.fields}, self.custom)

    def body(self) -> dict:
        def one(f: Field) -> dict:
            out: dict[str, Any] = {"type": f.type}
            for k in ("analyzer", "search_analyzer", "normalizer"):
                if getattr(f, k):
                    out[k] = getattr(f, k)
            if f.type == "date":
                out["format"] = f.format
            if f.prefixes:
                out["index_prefixes"] = {"min_chars": f.prefixes[0], "max_chars": f.prefixes[1]}
            if f.fields:
                out["fields"] = {k: one(v) for k, v in f.fields.items()}
            return out

        return {"properties": {k: one(v) for k, v in self.fields.items()}}


def infer_value(v: Any) -> str:
    """The type that dynamic mapping gives a JSON value."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "keyword" if v.isdigit() and v.isascii() else "text"
    if isinstance(v, list):
        return next((t for t in map(infer_value, v) if t != "unknown"), "unknown")
    return "object" if isinstance(v, dict) else "unknown"


def _inferred(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return _inferred(t.elementType)
    if isinstance(t, T.StructType) and {f.name for f in t.fields} == {"lat", "lon"}:
        return "geo_point"
    names = {T.StringType: "text", T.IntegerType: "integer", T.LongType: "long", T.ShortType: "short", T.ByteType: "byte", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date"}
    return names.get(type(t), "object")


def _custom_analyzers(analysis: dict) -> dict[str, dict]:
    grams = {k: v for k, v in (analysis.get("tokenizer") or {}).items() if v.get("type") == "edge_ngram"}
    out = {}
    for name, a in (analysis.get("analyzer") or {}).items():
        if a.get("tokenizer") in grams:
            g = grams[a["tokenizer"]]
            out[name] = {"min": g.get("min_gram", 2), "max": g.get("max_gram", 20), "filters": tuple(a.get("filter", ()))}
    return out
