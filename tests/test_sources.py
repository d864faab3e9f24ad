import datetime as dt
import json

import pytest

from quillstone.operators.engine import Engine
from quillstone.plans.dsl import QueryError
from quillstone.sources import bulk, files, snapshot
from quillstone.streaming import ingest


def test_bulk_parsing():
    body = '{"index":{"_index":"a","_id":"1"}}\n{"x":1}\nnonsense\n{"delete":{"_index":"a","_id":"2"}}\n{"update":{"_index":"a","_id":"3"}}\n{"doc":{"x":3}}\n{"create":{"_index":"a","_id":"4"}}\n[1]\n'
    ops = bulk.parse(body)
    assert [(o.action, o.id, o.source, bool(o.error)) for o in ops] == [("index", "1", {"x": 1}, False), ("", None, None, True), ("delete", "2", None, False), ("update", "3", {"x": 3}, False), ("create", "4", None, True)]
    assert bulk.parse("") == []
    with pytest.raises(QueryError):
        bulk.parse("nonsense\n")


def test_bulk_apply_in_order(spark):
    docs = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "_ord long, _id string, x int")
    rows = [(0, "create", "a", 9), (1, "delete", "a", None), (2, "create", "a", 5), (3, "create", "a", 6), (4, "index", "c", 7), (5, "index", "c", 8), (6, "delete", "zz", None)]
    ops = spark.createDataFrame(rows, "seq long, action string, _id string, x int")
    got = {r["seq"]: r["status"] for r in bulk.statuses(docs, ops).collect()}
    assert got == {0: 409, 1: 200, 2: 201, 3: 409, 4: 201, 5: 201, 6: 200}
    out = {r["_id"]: (r["_ord"], r["x"]) for r in bulk.apply(docs, ops).collect()}
    assert out == {"a": (0, 5), "b": (1, 2), "c": (6, 8)}


def test_bulk_files(spark, tmp_path):
    (tmp_path / "b.ndjson").write_text('{"index":{"_index":"a","_id":"1"}}\n{"x":1}\n{"delete":{"_index":"a","_id":"2"}}\n')
    rows = bulk.read(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r["action"], r["_id"], r["source"]) for r in rows] == [("index", "1", '{"x":1}'), ("delete", "2", None)]


def test_addresses(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id;numero;rep;nom_voie;code_postal;code_insee;nom_commune;lon;lat\n1;10;B;Cours;33000;33063;Bordeaux;-0.57;44.84\n2;;;Rue X;75001;;Paris;2.3;48.8\n")
    docs = files.address_documents(files.addresses(spark, str(p))).orderBy("id").collect()
    assert [d["label"] for d in docs] == ["10B Cours 33000 Bordeaux", "Rue X 75001 Paris"]
    p.write_text(p.read_text() + "3;;;Rue Y;75001;;Paris;999;48.8\n")
    with pytest.raises(files.SourceError):
        files.addresses(spark, str(p))
    assert files.addresses(spark, str(p), lenient=True).count() == 2


def test_snapshots(spark, tmp_path):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, "x y"), (2, "y")], "id long, t string"), "id")
    e.update_aliases([{"add": {"index": "a", "alias": "z"}}])
    r = snapshot.Repository(spark, f"file://{tmp_path}/repo")
    r.create(e, "s1")
    assert r.list() == ["s1"] and r.verify("s1")
    with pytest.raises(QueryError):
        r.restore(e, "s1")
    f = Engine(spark)
    assert r.restore(f, "s1") == ["a"] and f.hits("z", {"query": {"match": {"t": "y"}}}).total == 2
    r.delete("s1")
    assert r.list() == []


def test_lifecycle():
    at = dt.datetime(2024, 5, 6, 1, 30)  # a Monday
    assert snapshot.cron_matches("0 30 1 * * ?", at) and snapshot.cron_matches("*/15 1 * * 1", at) and not snapshot.cron_matches("0 2 * * *", at)
    assert snapshot.next_run("0 2 * * *", at) == dt.datetime(2024, 5, 6, 2, 0)
    assert snapshot.snapshot_name("<day-{now/d}>", at) == "day-2024.05.06"
    old = [(f"s{i}", at - dt.timedelta(days=i)) for i in range(5)]
    assert snapshot.expired(snapshot.Policy("p", "", max_count=3), old, at) == ["s4", "s3"]
    assert snapshot.expired(snapshot.Policy("p", "", expire_after=dt.timedelta(days=1), min_count=4), old, at) == ["s4"]


def test_streaming_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(0, "index", "a", {"x": 1}), (1, "index", "b", {"x": 2})], [(2, "index", "a", {"x": 3}), (3, "delete", "b", None)]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"seq": s, "action": a, "_id": i, "source": json.dumps(d) if d else None}) for s, a, i, d in rows))
    lines = spark.readStream.schema("seq long, action string, _id string, source string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.upsert_stream(lines, str(tmp_path / "t"), "x int", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["_id"], r["x"]) for r in ingest.latest(spark, str(tmp_path / "t")).collect()] == [("a", 3)]
