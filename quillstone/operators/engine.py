"""The engine: indices as DataFrames, and requests answered as Spark plans.

An index is a DataFrame with ``_ord`` (place in natural order, the tie break of every ranking), ``_id`` and its
fields. Metadata lives on the driver; nothing here brings more than a page of hits or buckets to it. ``matches`` gives all
hits of a request as rows.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import re
import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as tx
from quillstone.plans import dsl
from quillstone.plans.compiler import TOKENS, Compiler
from quillstone.plans.dsl import QueryError
from quillstone.plans.mapping import Mapping
from quillstone.sources import bulk as bulk_source

from . import aggregations, highlight

WINDOW = 10_000
#: A scroll reads so many hits ahead at least.
AHEAD = 1_000
#: Bytes of a bulk request.
BODY = 16 << 20


@dataclass
class Index:
    name: str
    docs: DataFrame
    mapping: Mapping
    settings: dict = field(default_factory=dict)
    version: int = 0


def check_name(name: str) -> str:
    if not name or name[0] in "_-+" or name != name.lower() or name in (".", "..") or re.search(r'[\\/*?"<>| ,#:\s]', name):
        raise QueryError(f"Invalid index name [{name}]", 400, "invalid_index_name_exception")
    return name


def missing(name: str) -> QueryError:
    return QueryError(f"no such index [{name}]", 404, "index_not_found_exception")


def merge(a: dict, b: dict) -> dict:
    """Recursive merge of settings; ``b`` wins."""
    return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}


@dataclass
class Hits:
    """A ranked page as a DataFrame, with the totals that belong to it, and all matches in that order."""

    page: DataFrame
    ranked: DataFrame
    total: int | None
    relation: str
    max_score: float | None


class Engine:
    def __init__(self, spark: SparkSession, today: dt.date | None = None):
        self.spark, self.today = spark, today
        self.indices: dict[str, Index] = {}
        self.aliases: dict[str, dict[str, dict]] = {}
        self.templates: dict[str, dict] = {}
        self.components: dict[str, dict] = {}
        self._scrolls: dict[str, dict] = {}
        self._cache: dict[tuple, dict] = {}
        self._versions = itertools.count(1)  # never used twice, so a re-created index has none of its predecessor's
        self._requests = {"search": 0, "bulk": 0, "count": 0}

    # ------------------------------------------------------------ catalogue

    def create(self, name: str, body: dict | None = None, docs: DataFrame | None = None) -> Index:
        """Create an index, with matching templates applied by ascending priority, then name; the body wins."""
        check_name(name)
        if name in self.indices or name in self.aliases:
            raise QueryError(f"index [{name}] already exists", 400, "resource_already_exists_exception")
        if set(body or {}) - {"settings", "mappings", "aliases"}:
            raise QueryError("an index takes [settings], [mappings] and [aliases]")
        full: dict = {}
        for _, t in sorted(self.templates.items(), key=lambda x: (x[1].get("priority", 0), x[0])):
            if any(re.fullmatch(tx.wildcard_regex(p).removeprefix("^(?s)").removesuffix("$"), name, re.S) for p in t["index_patterns"]):
                full = merge(full, t["template"])
        full = merge(full, body or {})
        mapping = Mapping.parse(full.get("mappings"), full.get("settings"))
        if docs is None:
            docs = self.spark.createDataFrame([], "_ord long, _id string")
        self.indices[name] = Index(name, docs, mapping.infer(docs.schema), full.get("settings", {}), next(self._versions))
        for a, definition in (full.get("aliases") or {}).items():
            self.aliases.setdefault(a, {})[name] = definition
        return self.indices[name]

    def register(self, name: str, docs: DataFrame, key: str, mappings: dict | None = None, keep: bool = False) -> Index:
        """A DataFrame as an index; ``key`` is its id and, if it is a number, its natural order."""
        order = F.col(key).cast("long") if isinstance(docs.schema[key].dataType, T.NumericType) else F.xxhash64(key)
        fields = docs.columns if keep else [c for c in docs.columns if c != key]
        return self.create(name, {"mappings": mappings} if mappings else None, docs.select(order.alias("_ord"), F.col(key).cast("string").alias("_id"), *fields))

    def delete(self, name: str) -> None:
        if name not in self.indices:
            raise missing(name)
        del self.indices[name]
        for members in self.aliases.values():
            members.pop(name, None)
        self.aliases = {a: m for a, m in self.aliases.items() if m}

    def resolve(self, name: str) -> list[Index]:
        """The index of that name, or all of an alias, in name order."""
        if name in self.indices:
            return [self.indices[name]]
        if name in self.aliases:
            return [self.indices[i] for i in sorted(self.aliases[name])]
        raise missing(name)

    def write_target(self, name: str) -> str:
        """Where writes to a name go: the index, an alias's only or marked index, or an index yet to be created."""
        if name not in self.aliases:
            return check_name(name)
        marked = [i for i, d in self.aliases[name].items() if d.get("is_write_index")]
        if len(self.aliases[name]) == 1 or len(marked) == 1:
            return (marked or list(self.aliases[name]))[0]
        raise QueryError(f"no write index is defined for alias [{name}]", 400, "illegal_argument_exception")

    def put_mapping(self, name: str, body: dict) -> None:
        for i in self.resolve(name):
            i.mapping = i.mapping.merge(Mapping.parse(body))
            i.version = next(self._versions)

    def get_mapping(self, name: str) -> dict:
        return {i.name: {"mappings": i.mapping.body()} for i in self.resolve(name)}

    def update_aliases(self, actions: list[dict]) -> None:
        """Adds are validated before anything is applied; definitions are kept as they are."""
        for a in actions:
            (kind, b), = a.items()
            if kind not in ("add", "remove") or not b.get("alias"):
                raise QueryError("unknown alias action")
            if kind == "add" and b.get("index") not in self.indices:
                raise missing(b.get("index", ""))
        for a in actions:
            (kind, b), = a.items()
            if kind == "add":
                self.aliases.setdefault(b["alias"], {})[b["index"]] = {k: v for k, v in b.items() if k not in ("index", "alias")}
            elif self.aliases.get(b["alias"], {}).pop(b["index"], None) is None:
                raise QueryError(f"aliases [{b['alias']}] missing", 404, "aliases_not_found_exception")
        self.aliases = {a: m for a, m in self.aliases.items() if m}

    def put_component(self, name: str, body: dict) -> None:
        self.components[name] = body.get("template", {})

    def put_template(self, name: str, body: dict) -> None:
        """Components are copied when the template is put."""
        if not body.get("index_patterns") or body.get("priority", 0) < 0:
            raise QueryError("a template needs [index_patterns] and a priority of 0 or more")
        unknown = [c for c in body.get("composed_of", []) if c not in self.components]
        if unknown:
            raise QueryError(f"component templates {unknown} do not exist")
        full = reduce(merge, [self.components[c] for c in body.get("composed_of", [])], {})
        self.templates[name] = {**body, "template": merge(full, body.get("template", {}))}

    def refresh(self, name: str, path: str) -> Index:
        """Write an index with its analyzed text fields, so that searches read tokens instead of making them."""
        i = self.resolve(name)[0]
        c = Compiler(i.mapping, i.docs.schema)
        texts = [f for f, spec in i.mapping.fields.items() if spec.type == "text" and c.known(f)]
        i.docs.withColumns({TOKENS.format(f): c.tokens(f) for f in texts}).write.mode("overwrite").parquet(path)
        i.docs, i.version = self.spark.read.parquet(path), next(self._versions)
        return i

    # ------------------------------------------------------------ search

    def compiler(self, i: Index) -> Compiler:
        return Compiler(i.mapping, i.docs.schema, self.today)

    def matched(self, i: Index, q: dsl.Query, min_score: float | None = None) -> DataFrame:
        """The matching documents, with ``_score`` (null if the query does not score)."""
        plain = self.compiler(i)
        docs, c = plain.prepared(i.docs, q)
        out = docs.filter(c.predicate(q))
        score = F.lit(None).cast("double")
        if q.scoring:
            stats = plain.statistics(i.docs, q)
            out, c = c.counted(out, q, stats)
            score = c.score(q, stats)
        out = out.select(*[F.col(f"`{n}`") for n in i.docs.columns], score.alias("_score"))
        return out if min_score is None or not q.scoring else out.filter(F.col("_score") >= min_score)

    def _all(self, target: str, q: dsl.Query, min_score: float | None = None) -> DataFrame:
        """Matches of all indices of a target; statistics are each index's own."""
        found = self.resolve(target)
        parts = [self.matched(i, q, min_score).withColumns({"_index": F.lit(i.name), "_rank": F.lit(n)}) for n, i in enumerate(found)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def hits(self, target: str, body: dict | None = None, deep: bool = False) -> Hits:
        """``deep`` lifts the limit of the window, as later pages of a scroll need."""
        body = body or {}
        start, size = _window(body, deep)
        found, ranked = self._ranked(target, body)
        page = ranked.offset(start).limit(size)
        totals = body.get("track_total_hits", WINDOW)
        summary = found.agg(F.count("*").alias("n"), F.max("_score").alias("m")).first()
        total, relation = summary["n"], "eq"
        if totals is False:
            total = None
        elif totals is not True and total > totals:
            total, relation = totals, "gte"
        return Hits(page, ranked, total, relation, summary["m"])

    def _ranked(self, target: str, body: dict) -> tuple[DataFrame, DataFrame]:
        """All matches of a body, and the same in the order of its pages."""
        q, low = _asked(body)
        found = self._all(target, q, low)
        order = sort_columns(body.get("sort"), self.compiler(self.resolve(target)[0]), q.scoring)
        return found, found.orderBy(*order, "_rank", "_ord")

    def pages(self, target: str, body: dict | None = None) -> DataFrame:
        """A scroll read to its end, as rows: all matches with ``_at``, the place in their order, and ``_page``, the page that has them."""
        start, size = _window(body or {}, True)
        if not size:
            raise QueryError("[size] must be positive")
        rows = numbered(self._ranked(target, body or {})[1])
        return rows.filter(F.col("_at") >= start).withColumn("_page", F.expr(f"CAST((_at - {start}L) DIV {size} AS INT)"))

    def matches(self, target: str, body: dict | None = None) -> DataFrame:
        """All that a body matches, in no order: the window of pages does not hold for rows that stay in Spark.

        ``_index``, ``_id``, ``_ord``, ``_score`` and the fields that ``_source`` asks for; with ``highlight`` the marks of each row.
        """
        body = body or {}
        q, low = _asked(body)
        found = self._all(target, q, low)
        names = [n for n in found.columns if not n.startswith("_")]
        shown = [F.col(f"`{n}`") for n in source_filter(dict.fromkeys(names), body.get("_source", True)) or ()]
        if body.get("highlight"):
            found = highlight.marked(found, q, body["highlight"], "_highlight")
            shown.append(F.col("_highlight").alias("highlight"))
        return found.select("_index", "_id", "_ord", "_score", *shown)

    def search(self, target: str, body: dict | None = None, scroll: str | None = None, request_cache: bool = True, deep: bool = False) -> dict:
        """A whole response body."""
        body = body or {}
        self._requests["search"] += 1
        began = time.time()
        indices = self.resolve(target)
        key = (tuple((i.name, i.version) for i in indices), json.dumps(body, sort_keys=True, default=str))
        if request_cache and scroll is None and len(indices) == 1 and key in self._cache:
            return self._cache[key]
        q = dsl.parse(body["query"]) if body.get("query") else dsl.MatchAll()
        found = self.hits(target, body, deep)
        start, size = _window(body, deep)
        hits: dict = {"max_score": found.max_score, "hits": shown(found.page.collect() if size else [], q, body)}
        if found.total is not None:
            hits = {"total": {"value": found.total, "relation": found.relation}, **hits}
        out = {"took": int((time.time() - began) * 1000), "timed_out": False, "_shards": {"total": 1, "successful": 1, "skipped": 0, "failed": 0}, "hits": hits}
        spec = aggregations.parse(body.get("aggs") or body.get("aggregations"))
        if spec:
            c = self.compiler(indices[0])
            matches = self._all(target, q, body.get("min_score"))
            if len(spec) > 1:
                matches = matches.persist()  # one match set for all
            try:
                out["aggregations"] = aggregations.run(matches, spec, lambda f: field_values(c, f), c.is_array)
            finally:
                matches.unpersist()
        if scroll is not None:
            state = {"target": target, "body": body, "size": size, "at": start + size, "read": [], "first": out, "ranked": found.ranked, "rows": None}
            out = {**out, "_scroll_id": self._keep(state, scroll)}
        elif request_cache and len(indices) == 1:
            if len(self._cache) >= 256:
                del self._cache[next(iter(self._cache))]
            self._cache[key] = out
        return out

    def _keep(self, state: dict, ttl: str) -> str:
        m = re.fullmatch(r"(\d+)(ms|s|m|h)", ttl or "1m")
        if not m:
            raise QueryError(f"failed to parse scroll [{ttl}]")
        life = int(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[m[2]]
        now, token = time.time(), uuid.uuid4().hex
        self._scrolls = {k: s for k, s in self._scrolls.items() if s["until"] >= now}
        self._scrolls[token] = {**state, "ttl": ttl, "until": now + life}
        return token

    def scroll(self, token: str, ttl: str | None = None) -> dict:
        """The next page; each page has a new id, an unknown or old one is an error.

        The second page stores all matches with their places, later ones read on there: all show the index as it was at first.
        """
        s = self._scrolls.pop(token, None)
        if s is None or s["until"] < time.time():
            raise QueryError("No search context found", 404, "search_context_missing_exception")
        began = time.time()
        self._requests["search"] += 1
        self.resolve(s["target"])
        rows, read, size = s["rows"], s["read"], s["size"]
        if size and len(read) < size:
            rows = numbered(s["ranked"]) if rows is None else rows
            start = s["at"] + len(read)
            read = read + rows.filter(F.col("_at").between(start, start + max(size, AHEAD) - 1)).orderBy("_at").collect()
        hits = shown(read[:size], _asked(s["body"])[0], s["body"])
        out = {**s["first"], "took": int((time.time() - began) * 1000), "hits": {**s["first"]["hits"], "hits": hits}}
        if hits:
            out["_scroll_id"] = self._keep({**s, "at": s["at"] + size, "read": read[size:], "rows": rows}, ttl or s["ttl"])
        return out

    def msearch(self, lines: str, target: str | None = None) -> dict:
        """Header and body lines in turn; an error stays with its request."""
        rows = [x for x in lines.split("\n") if x.strip()]
        out = []
        for head, body in zip(rows[::2], rows[1::2]):
            try:
                name = json.loads(head).get("index") or target
                out.append({**self.search(name[0] if isinstance(name, list) else name, json.loads(body)), "status": 200})
            except QueryError as e:
                out.append(e.body())
            except (json.JSONDecodeError, AttributeError) as e:
                out.append({"error": {"type": "parsing_exception", "reason": str(e)}, "status": 400})
        return {"responses": out}

    def count(self, target: str, body: dict | None = None) -> int:
        """Exact number of matches, in the smaller grammar that counting has; an integer track_total_hits caps it."""
        self._requests["count"] += 1
        q = dsl.parse(body["query"]) if body and body.get("query") is not None else dsl.MatchAll()
        _countable(q)
        found = self._all(target, q).select("_ord")
        cap = (body or {}).get("track_total_hits")
        return found.limit(cap).count() if isinstance(cap, int) and not isinstance(cap, bool) else found.count()

    def mget(self, target: str, ids: list[str]) -> DataFrame:
        """Documents by id in the order asked for; ``found`` tells those that are missing. The ids are one request's."""
        wanted = self.spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "_at int, _id string")
        docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [i.docs.withColumns({"_index": F.lit(i.name), "_rank": F.lit(n)}) for n, i in enumerate(self.resolve(target))])
        docs = docs.filter(F.col("_id").isin(ids)) if len(ids) <= 1000 else docs
        best = Window.partitionBy("_id").orderBy("_rank")
        docs = docs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_rank")
        return wanted.join(docs, "_id", "left").withColumn("found", F.col("_index").isNotNull()).orderBy("_at").drop("_at")

    def scan(self, target: str, start: int = 0, size: int | None = None) -> DataFrame:
        """All documents in natural order, or a window of them."""
        out = self._all(target, dsl.MatchAll()).drop("_score").orderBy("_rank", "_ord")
        return out if size is None else out.offset(start).limit(size)

    def boolean_terms(self, target: str, terms: list[tuple[str, str]], size: int = 10) -> DataFrame:
        """(_id, _score): documents that have every (field, exact term), by the sum of the terms' scores."""
        if size <= 0:
            raise QueryError("[size] must be positive")
        i = self.resolve(target)[0]
        q = dsl.Bool(must=tuple(dsl.Match(f, w, True) for f, w in terms))
        return self.matched(i, q).orderBy(F.desc("_score"), "_ord").limit(size).select("_id", "_score")

    # ------------------------------------------------------------ writing

    def bulk(self, body: str, target: str | None = None) -> dict:
        """Apply a request body of operations in order; unknown indices are created, aliases lead to their write index."""
        self._requests["bulk"] += 1
        if len(body.encode()) > BODY:
            raise QueryError(f"a body has at most {BODY} bytes", 413, "content_too_long_exception")
        ops = bulk_source.parse(body, target)
        items: list[dict] = [{} for _ in ops]
        by: dict[str, list] = {}
        for o in ops:
            if o.error:
                items[o.seq] = {o.action or "index": {"status": 400, "error": {"type": "parsing_exception", "reason": o.error}}}
            else:
                by.setdefault(self.write_target(o.index), []).append(replace(o, id=uuid.uuid4().hex if o.id is None else str(o.id)))
        for name, mine in by.items():
            for o, status in zip(mine, self._write(name, mine)):
                failed = {"error": {"type": "version_conflict_engine_exception", "reason": "document already exists"}} if status == 409 else {}
                items[o.seq] = {o.action: {"_index": name, "_id": o.id, "status": status, **failed}}
        return bulk_source.response(items)

    def put_document(self, target: str, key: str, source: dict) -> dict:
        """Write one document whole; it is always reported as created."""
        if not isinstance(source, dict):
            raise QueryError("a document must be an object")
        name = self.write_target(target)
        self._write(name, [bulk_source.Operation(0, "index", name, key, source)])
        return {"_index": name, "_id": key, "_version": 1, "result": "created"}

    def _write(self, name: str, ops: list) -> list[int]:
        """Statuses of one index's operations, in order; the operations are one request's."""
        i = self.indices.get(name) or self.create(name)
        text = self.spark.createDataFrame([(o.seq, o.action, o.id, json.dumps(o.source) if o.source is not None else None) for o in ops], "seq long, action string, _id string, source string")
        fields = {k: v for o in ops for k, v in (o.source or {}).items() if v is not None}
        have = {f.name: f.dataType for f in i.docs.schema.fields}
        new = {k: t for k, v in fields.items() if k not in have and (t := json_type(v)) is not None}
        docs = i.docs.select("*", *[F.lit(None).cast(t).alias(k) for k, t in new.items()])
        made = [f for f in docs.columns if not f.startswith("_")]
        kept = docs.select("_ord", "_id", *made)
        if made:
            kind = T.StructType([kept.schema[f] for f in made])
            parsed = text.withColumn("s", F.from_json("source", kind)).select("seq", "action", "_id", *[F.col("s")[f].alias(f) for f in made])
        else:
            parsed = text.select("seq", "action", "_id")
        judged = {r["seq"]: r["status"] for r in bulk_source.statuses(kept, parsed).select("seq", "status").collect()}
        i.docs = bulk_source.apply(kept, parsed)
        i.mapping, i.version = i.mapping.infer(i.docs.schema), next(self._versions)
        return [judged[o.seq] for o in ops]

    # ------------------------------------------------------------ looking around

    def banner(self) -> dict:
        return {"name": "node-0", "cluster_name": "quillstone", "version": {"number": "2.17.1", "distribution": "opensearch"}, "tagline": "Search as Spark plans"}

    def get_index(self, name: str) -> dict:
        return {i.name: {"aliases": {a: m[i.name] for a, m in self.aliases.items() if i.name in m}, "mappings": i.mapping.body(), "settings": i.settings} for i in self.resolve(name)}

    def stats(self) -> dict:
        """Documents and planned bytes of every index."""
        size = lambda i: int(str(i.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return {"indices": {n: {"docs": {"count": i.docs.count()}, "store": {"size_in_bytes": size(i)}} for n, i in sorted(self.indices.items())}}

    def metrics(self) -> str:
        """Counters in the text format that scrapers read."""
        lines = [line for k, v in sorted(self._requests.items()) for line in (f"# TYPE quillstone_{k}_requests_total counter", f"quillstone_{k}_requests_total {v}")]
        return "\n".join([*lines, "# TYPE quillstone_indices gauge", f"quillstone_indices {len(self.indices)}", ""])

    def cat_health(self) -> list[dict]:
        n = str(len(self.indices))
        return [{"cluster": "quillstone", "status": "green", "node.total": "1", "node.data": "1", "shards": n, "pri": n, "relo": "0", "init": "0", "unassign": "0", "active_shards_percent": "100.0%"}]

    def field_caps(self, target: str, fields: list[str]) -> dict:
        out: dict[str, dict] = {}
        for i in self.resolve(target):
            for name, f in i.mapping.fields.items():
                if "*" in fields or name in fields:
                    out.setdefault(name, {})[f.type] = {"type": f.type, "searchable": True, "aggregatable": f.type not in ("text", "object", "array")}
        return {"indices": [i.name for i in self.resolve(target)], "fields": out}

    def cat_indices(self) -> list[dict]:
        return [{"health": "green", "status": "open", "index": n, "docs.count": str(self.indices[n].docs.count())} for n in sorted(self.indices)]

    def cat_aliases(self) -> list[dict]:
        return [{"alias": a, "index": i} for a in sorted(self.aliases) for i in sorted(self.aliases[a])]

    def cat_count(self, target: str) -> list[dict]:
        return [{"count": str(self.count(target))}]

    def health(self, index: str | None = None) -> dict:
        if index is not None and index not in self.indices:
            raise missing(index)
        return {"status": "green", "number_of_nodes": 1, "active_primary_shards": 1 if index else len(self.indices)}


def json_type(v) -> T.DataType | None:
    """The type of a column that takes a JSON value; none for null."""
    if isinstance(v, dict):
        inner = {k: json_type(x) for k, x in v.items()}
        return T.StructType([T.StructField(k, t) for k, t in inner.items() if t is not None])
    if isinstance(v, list):
        first = next((t for t in map(json_type, v) if t is not None), T.StringType())
        return T.ArrayType(first)
    return next((t for kind, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())) if isinstance(v, kind)), None)


def _window(body: dict, deep: bool = False) -> tuple[int, int]:
    start, size = body.get("from", 0), body.get("size", 10)
    for k, v in (("from", start), ("size", size)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise QueryError(f"[{k}] must be a number of 0 or more")
    if not deep and start + (size if "size" in body else 0) > WINDOW:
        raise QueryError(f"Result window is too large, from + size must be at most {WINDOW}", 400, "illegal_argument_exception")
    return start, size


def _asked(body: dict) -> tuple[dsl.Query, float | None]:
    """A body's query and least score."""
    low = body.get("min_score")
    if low is not None and (isinstance(low, bool) or not isinstance(low, (int, float)) or low < 0):
        raise QueryError("[min_score] must be a number of 0 or more")
    return dsl.parse(body["query"]) if body.get("query") else dsl.MatchAll(), low


def _countable(q: dsl.Query) -> None:
    if isinstance(q, dsl.Bool):
        if q.filter or q.must_not or q.should:
            raise QueryError("counting knows [bool] with [must] only")
        for c in q.must:
            _countable(c)
    elif not isinstance(q, (dsl.MatchAll, dsl.Term, dsl.Terms, dsl.Range, dsl.Exists, dsl.Prefix, dsl.Wildcard, dsl.MultiMatch)):
        raise QueryError(f"counting does not know [{type(q).__name__}]")


def field_values(c: Compiler, name: str):
    """A field's values for sorting and aggregating: of a multi-field its first token, else what is stored."""
    f = c.mapping.get(name)
    if f and "." in name and name not in c.schema.fieldNames():
        return F.get(c.tokens(name), 0)
    return c.col(name)


def sort_columns(spec, c: Compiler, scoring: bool) -> list:
    """Sort keys; missing values last in either direction, score first if nothing is asked for."""
    if spec is None:
        return [F.desc("_score")] if scoring else []
    out = []
    for s in spec if isinstance(spec, list) else [spec]:
        if isinstance(s, str):
            name, order = s, "desc" if s == "_score" else "asc"
        elif isinstance(s, dict) and len(s) == 1:
            (name, b), = s.items()
            order = b.get("order", "desc" if name == "_score" else "asc") if isinstance(b, dict) else b
        else:
            raise QueryError("malformed sort")
        if order not in ("asc", "desc"):
            raise QueryError(f"unknown sort order [{order}]")
        col = F.col("_score") if name == "_score" else F.col("_ord") if name == "_doc" else field_values(c, name)
        out.append(col.asc_nulls_last() if order == "asc" else col.desc_nulls_last())
    return out


def numbered(ranked: DataFrame) -> DataFrame:
    """The rows of a sorted frame with their places from 0 as ``_at``, stored, so that a place is a row's for good.

    Each partition counts its own rows; the driver gets one number of each.
    """
    rows = ranked.withColumn("_at", F.monotonically_increasing_id())  # the partition's number and the place in it
    rows = rows.checkpoint() if ranked.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(rows.groupBy(part).count().collect())
    first = [0, *itertools.accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    return rows.withColumn("_at", F.col("_at") % (1 << 33) + F.get(F.lit(first).cast("array<long>"), part))


def shown(rows: list, q: dsl.Query, body: dict) -> list[dict]:
    """The hits of a response."""
    out = []
    for r in rows:
        source = {k: v for k, v in r.asDict(True).items() if not k.startswith("_") and v is not None}
        hit = {"_index": r["_index"], "_id": r["_id"], **({"_score": r["_score"]} if q.scoring else {})}
        kept = source_filter(source, body.get("_source", True))
        if kept is not None:
            hit["_source"] = kept
        if body.get("highlight") and (marks := highlight.highlight(q, source, body["highlight"])):
            hit["highlight"] = marks
        out.append(hit)
    return out


def source_filter(source: dict, spec) -> dict | None:
    """Exact top-level names to show; None for no source at all."""
    if spec is True or spec is None:
        return source
    if spec is False:
        return None
    if isinstance(spec, dict):
        inc, exc = spec.get("includes"), spec.get("excludes")
    else:
        inc, exc = spec, None
    inc, exc = ([x] if isinstance(x, str) else x for x in (inc, exc))
    return {k: v for k, v in source.items() if (not inc or k in inc) and k not in (exc or ())}
