import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import aggregations as ag
from quillstone.operators import highlight as hl
from quillstone.operators import relevance as rv
from quillstone.operators.engine import Engine
from quillstone.plans import dsl
from quillstone.plans.dsl import QueryError
from quillstone.plans.mapping import Mapping, infer_value

ROWS = [
    (1, "Laptop Pro 14", "electronics", 1299, True, "20240115", ["a", "b"]), (2, "Desk Lamp", "home", 49, True, "20240220", ["b"]),
    (3, "Running Shoes", "sports", 89, False, "20240221", []), (4, "Lamp Oil lamp", "home", None, None, None, None),
]


@pytest.fixture()
def engine(spark):
    e = Engine(spark, dt.date(2024, 3, 1))
    docs = spark.createDataFrame(ROWS, "id long, name string, category string, price int, in_stock boolean, day string, tags array<string>")
    e.register("products", docs, "id", {"properties": {"category": {"type": "keyword"}, "day": {"type": "date"}, "tags": {"type": "keyword"}}})
    return e


def ids(engine, query, **body):
    return [h["_id"] for h in engine.search("products", {"query": query, **body})["hits"]["hits"]]


@pytest.mark.parametrize(
    "query, want",
    [
        ({"match_all": {}}, "1234"), ({"match": {"name": "lamp"}}, "42"), ({"match": {"name": {"query": "desk lamp", "operator": "and"}}}, "2"), ({"match": {"name": "14"}}, ""),
        ({"match_phrase": {"name": "desk lamp"}}, "2"), ({"term": {"category": "home"}}, "24"), ({"terms": {"category": ["home", "sports"]}}, "234"), ({"match": {"tags": "b"}}, "12"),
        ({"range": {"price": {"gte": 49, "lt": 1000}}}, "23"), ({"range": {"day": {"gte": "now-10d", "lte": "now"}}}, "23"), ({"range": {"day": {"gt": "x"}}}, ""), ({"exists": {"field": "price"}}, "123"),
        ({"exists": {"field": "tags"}}, "12"), ({"prefix": {"name": "la"}}, "124"), ({"wildcard": {"name": "l?mp"}}, "24"), ({"fuzzy": {"name": {"value": "lapm", "fuzziness": 1}}}, "24"),
        ({"multi_match": {"query": "home laptop", "fields": ["name", "category"]}}, "1"), ({"bool": {"must_not": [{"term": {"category": "home"}}]}}, "13"), ({"term": {"nothing": "x"}}, ""),
        ({"bool": {"should": [{"term": {"category": "home"}}, {"match": {"name": "oil"}}, {"exists": {"field": "price"}}], "minimum_should_match": 2}}, "42"),
    ],
)
def test_queries(engine, query, want):
    assert "".join(ids(engine, query)) == want or sorted(ids(engine, query)) == sorted(want)


@pytest.mark.parametrize(
    "query",
    [
        {}, {"match": {}, "term": {}}, {"nope": {}}, {"bool": {}}, {"terms": {"f": []}}, {"prefix": {"f": ""}}, {"range": {"f": {}}}, {"range": {"f": {"x": 1}}}, {"geo_distance": {"f": [0, 0]}},
        {"geo_distance": {"distance": "1km", "f": [0, 95]}}, {"geo_polygon": {"f": {"points": [[0, 0]]}}}, {"function_score": {"functions": [{"script_score": {}}]}}, {"multi_match": {"query": "x", "fields": ["a^2"]}},
        {"match": {"f": {"query": "x", "operator": "xor"}}}, {"bool": {"should": [{"match_all": {}}], "minimum_should_match": "x%"}}, {"fuzzy": {"f": {"value": "x", "fuzziness": 5}}}, {"match_all": {"x": 1}},
    ],
)
def test_bad_queries(query):
    with pytest.raises(QueryError):
        dsl.parse(query)


def test_minimum_should_match():
    of = lambda n, m: dsl.parse({"bool": {"should": [{"match_all": {}}] * n, "minimum_should_match": m}}).required()
    assert [of(4, 2), of(4, -1), of(4, "70%"), of(4, "-30%"), of(4, 9), of(4, -9)] == [2, 3, 2, 2, 4, 0]
    assert dsl.parse({"bool": {"should": {"match_all": {}}}}).required() == 1
    assert dsl.parse({"bool": {"should": {"match_all": {}}, "filter": {"match_all": {}}}}).required() == 0


def test_scores_follow_the_bool_rule(engine):
    s = lambda q: {h["_id"]: h["_score"] for h in engine.search("products", {"query": q})["hits"]["hits"]}
    assert set(s({"bool": {"filter": {"term": {"category": "home"}}, "boost": 2}}).values()) == {2.0}
    lamp = s({"match": {"name": "lamp"}})
    assert lamp["4"] > lamp["2"] > 0
    both = s({"bool": {"must": [{"match": {"name": "lamp"}}, {"exists": {"field": "name"}}], "should": [{"term": {"category": "home"}}]}})
    assert both["2"] == pytest.approx(lamp["2"] + 1.0)
    twice = s({"match": {"name": "lamp lamp"}})
    assert twice["2"] == pytest.approx(2 * lamp["2"])


def test_pages_sorting_and_totals(engine):
    assert ids(engine, {"match_all": {}}, sort=[{"price": "desc"}]) == ["1", "3", "2", "4"]
    assert ids(engine, {"match_all": {}}, sort=["price"]) == ["2", "3", "1", "4"]
    assert ids(engine, {"match_all": {}}, **{"from": 1, "size": 2}) == ["2", "3"]
    out = engine.search("products", {"track_total_hits": 2, "size": 0})
    assert out["hits"]["total"] == {"value": 2, "relation": "gte"} and out["hits"]["hits"] == []
    with pytest.raises(QueryError):
        engine.search("products", {"from": 9999, "size": 2})
    hit = engine.search("products", {"query": {"term": {"category": "sports"}}, "_source": {"includes": ["name", "price"], "excludes": "price"}})["hits"]["hits"][0]
    assert hit["_source"] == {"name": "Running Shoes"} and "_score" not in hit


def test_aggregations(engine):
    body = {"size": 0, "aggs": {"c": {"terms": {"field": "category"}}, "n": {"cardinality": {"field": "tags"}}, "d": {"date_histogram": {"field": "day", "calendar_interval": "month"}}, "p": {"composite": {"size": 1, "sources": [{"k": {"terms": {"field": "category"}}}]}}}}
    a = engine.search("products", body)["aggregations"]
    assert a["c"]["buckets"][0] == {"key": "home", "doc_count": 2} and a["n"]["value"] == 2
    assert [b["key"] for b in a["d"]["buckets"]] == ["20240101", "20240201"]
    assert a["p"] == {"buckets": [{"key": {"k": "electronics"}, "doc_count": 1}], "after_key": {"k": "electronics"}}
    with pytest.raises(QueryError):
        ag.parse({"x": {"avg": {"field": "price"}}})


def test_scroll_mget_msearch_count(engine):
    page = engine.search("products", {"size": 3}, scroll="1m")
    second = engine.scroll(page["_scroll_id"])
    assert [h["_id"] for h in second["hits"]["hits"]] == ["4"]
    with pytest.raises(QueryError):
        engine.scroll(page["_scroll_id"])
    assert [(r["_id"], r["found"]) for r in engine.mget("products", ["3", "x", "1"]).collect()] == [("3", True), ("x", False), ("1", True)]
    out = engine.msearch('{"index":"products"}\n{"size":1}\n{"index":"nope"}\n{}\n')
    assert [r["status"] for r in out["responses"]] == [200, 404]
    assert engine.count("products", {"query": {"term": {"category": "home"}}}) == 2
    with pytest.raises(QueryError):
        engine.count("products", {"query": {"match": {"name": "lamp"}}})


def test_catalogue(engine, spark):
    for bad in ("_x", "Upper", "a b", "", "-a", "a*"):
        with pytest.raises(QueryError):
            engine.create(bad)
    engine.put_component("c", {"template": {"settings": {"x": {"a": 1}}}})
    engine.put_template("t1", {"index_patterns": ["log-*"], "composed_of": ["c"], "priority": 1, "template": {"mappings": {"properties": {"m": {"type": "text"}}}}})
    engine.put_template("t2", {"index_patterns": ["*"], "priority": 5, "template": {"settings": {"x": {"b": 2}}}})
    i = engine.create("log-1", {"aliases": {"logs": {"is_write_index": True}}})
    assert i.settings == {"x": {"a": 1, "b": 2}} and i.mapping.fields["m"].type == "text"
    engine.create("log-2", {"aliases": {"logs": {}}})
    assert engine.write_target("logs") == "log-1" and engine.write_target("new") == "new"
    with pytest.raises(QueryError):
        engine.put_mapping("log-1", {"properties": {"m": {"type": "keyword"}}})
    engine.delete("log-1")
    assert engine.cat_aliases() == [{"alias": "logs", "index": "log-2"}]
    assert [infer_value(v) for v in ("12", "x", 1.5, 3, True, [None, "a"], {}, None)] == ["keyword", "text", "double", "integer", "boolean", "text", "object", "unknown"]
    with pytest.raises(QueryError):
        Mapping.parse({"properties": {"k": {"type": "keyword", "analyzer": "simple"}}})


def test_refresh_gives_the_same_results(engine, tmp_path):
    before = engine.search("products", {"query": {"match": {"name": "lamp pro"}}})["hits"]
    engine.refresh("products", str(tmp_path / "i"))
    assert engine.search("products", {"query": {"match": {"name": "lamp pro"}}})["hits"]["max_score"] == before["max_score"]


def test_highlighting():
    q = dsl.parse({"bool": {"must": [{"match": {"t": "fox"}}, {"match_phrase": {"t": "lazy dog"}}]}})
    text = "The Fox jumps over the lazy dog"
    assert hl.highlight(q, {"t": text}, {"fields": {"t": {}}}) == {"t": ["The <em>Fox</em> jumps over the <em>lazy dog</em>"]}
    assert hl.fragments(text, hl.spans(q, "t", text), 12, 1)[0].count("<em>") == 1


def test_relevance(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "b", 1), ("q", "z", 2)], "query_id string, doc_id string, rel int")
    import math

    want = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert rv.ndcg(hits, rel).first()["ndcg"] == pytest.approx(want)
    assert rv.recall(hits, rel).first()["recall"] == 0.5 and rv.recall(hits, rel, any_hit=True).first()["recall"] == 1.0
    values = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert {r["percent"]: r["v"] for r in rv.nearest_rank(values, "v", [50, 95, 99.5]).collect()} == {50.0: 50.0, 95.0: 95.0, 99.5: 100.0}
    assert rv.differences({"a": 1, "s_score": 1.0}, {"a": 2, "s_score": 1.01}, tolerance=0.1) == ["a"]
    assert rv.differences({"h": [{"took": 1}]}, {"h": [{"took": 2}]}, ignored=["h.*.took"]) == []


def test_geo_forms(spark):
    docs = spark.createDataFrame([(1, "48.85,2.35", [2.35, 48.85])], "id long, s string, a array<double>")
    e = Engine(spark)
    e.register("g", docs, "id")
    for f in ("s", "a"):
        assert e.hits("g", {"query": {"geo_distance": {"distance": "1km", f: "48.85,2.351"}}}).total == 1
        assert e.hits("g", {"query": {"geo_polygon": {f: {"points": [[0, 40], [10, 40], [5, 60]]}}}}).total == 1


def test_top_k_has_no_exchange_for_scoring(engine):
    c = engine.matched(engine.indices["products"], dsl.parse({"match": {"name": "lamp"}}))
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and json.dumps(plan)
    assert F is not None
