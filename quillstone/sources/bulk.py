"""Bulk operations: action and source lines to document states, as a Spark job."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.dsl import QueryError

ACTIONS = ("index", "create", "update", "delete")


@dataclass(frozen=True)
class Operation:
    seq: int
    action: str
    index: str | None
    id: str | None
    source: dict[str, Any] | None
    error: str | None = None


def parse(body: str, index: str | None = None) -> list[Operation]:
    """Operations of a request body in order; a bad line gives an operation with an error and parsing goes on.

    A body in which every operation is bad is refused with the first error; an empty one is fine.
    """
    lines = [x for x in body.split("\n") if x.strip()]
    out: list[Operation] = []
    at = 0
    while at < len(lines):
        seq = len(out)
        try:
            (action, meta), = json.loads(lines[at]).items()
            if action not in ACTIONS or not isinstance(meta, dict):
                raise ValueError(f"unknown action [{action}]")
        except (ValueError, AttributeError) as e:
            out.append(Operation(seq, "", None, None, None, f"malformed action: {e}"))
            at += 1
            continue
        at += 1
        target, key = meta.get("_index", index), meta.get("_id")
        source, error = None, None if target else "index is missing"
        if action != "delete":
            try:
                source = json.loads(lines[at]) if at < len(lines) else None
            except ValueError as e:
                error = error or f"malformed source: {e}"
            at += 1
            if error is None and not isinstance(source, dict):
                error = "source must be an object"
            elif action == "update" and isinstance(source, dict) and isinstance(source.get("doc"), dict):
                source = source["doc"]
        if error is None and key is None and action != "index" and action != "create":
            error = "id is missing"
        out.append(Operation(seq, action, target, key, source if error is None else None, error))
    if out and all(o.error for o in out):
        raise QueryError(out[0].error)
    return out


def read(spark, path: str) -> DataFrame:
    """(seq, action, _index, _id, source) of NDJSON files whose lines alternate, without a driver loop.

    ``seq`` is the line's place: the file's name and byte order within it, which text splits keep.
    """
    lines = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    is_action = F.col("line").rlike(r'^\s*\{\s*"(?:index|create|update|delete)"\s*:\s*\{')
    w = Window.partitionBy("file").orderBy("n")
    marked = lines.withColumn("action_line", is_action).withColumns({"next": F.lead("line").over(w), "next_is_action": F.lead(is_action).over(w)})
    action = F.regexp_extract("line", r'"(index|create|update|delete)"', 1)
    return marked.filter("action_line").select(
        "file", "n", action.alias("action"), F.call_function("get_json_object", F.col("line"), F.concat(F.lit("$."), action, F.lit("._index"))).alias("_index"),
        F.call_function("get_json_object", F.col("line"), F.concat(F.lit("$."), action, F.lit("._id"))).alias("_id"),
        F.when((action != "delete") & ~F.coalesce("next_is_action", F.lit(True)), F.when(action == "update", F.coalesce(F.get_json_object("next", "$.doc"), F.col("next"))).otherwise(F.col("next"))).alias("source"),
    )


def statuses(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """``ops`` with the status that each gets when applied in order: 201, 200 or, for create on a live id, 409.

    An id is live if the write before it on that id, or else the stored table, left a document.
    """
    live = docs.select("_id", F.lit(True).alias("__stored"))
    w = Window.partitionBy("_id").orderBy("seq")
    # A create only changes anything when the id is not live, so the last write before it that is no create, and whether any create came since, decide.
    last = F.last(F.when(F.col("action") != "create", F.col("action")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_at = F.last(F.when(F.col("action") != "create", F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    creates = F.last(F.when(F.col("action") == "create", F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = ops.join(live, "_id", "left").withColumns({"__last": last, "__at": last_at, "__create": creates})
    is_live = (
        F.when(F.col("__create") > F.coalesce("__at", F.lit(-1)), True).when(F.col("__last").isNotNull(), F.col("__last") != "delete").otherwise(F.coalesce("__stored", F.lit(False)))
    )
    status = F.when(F.col("action") == "create", F.when(is_live, 409).otherwise(201)).when(F.col("action") == "index", 201).otherwise(200)
    return found.withColumn("status", status).drop("__stored", "__last", "__at", "__create")


def apply(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """The table after ``ops`` (seq, action, _id and the columns of ``docs``): the last effective write of an id wins.

    Replaced documents keep their place in natural order; new ones follow in the order of their first write.
    """
    judged = statuses(docs, ops).filter("status <> 409")
    w = Window.partitionBy("_id")
    final = (
        judged.withColumns({"__n": F.row_number().over(w.orderBy(F.desc("seq"))), "__first": F.min("seq").over(w)}).filter("__n = 1")
    )
    fields = [c for c in docs.columns if c not in ("_ord", "_id")]
    kept = docs.join(final.select("_id"), "_id", "left_anti")
    most = docs.agg(F.coalesce(F.max("_ord"), F.lit(-1)).alias("m")).first()["m"]
    written = (
        final.filter("action <> 'delete'").join(docs.select("_id", F.col("_ord").alias("__old")), "_id", "left")
        .select(F.coalesce("__old", F.col("__first") + (most + 1)).alias("_ord"), "_id", *fields)
    )
    return kept.select("_ord", "_id", *fields).unionAll(written)


def response(items: list[dict]) -> dict:
    return {"took": 0, "errors": any(next(iter(i.values()))["status"] >= 400 for i in items), "items": items}


def write(docs: DataFrame, index: str):
    """Documents as action and source lines, one row each with both lines."""
    fields = [c for c in docs.columns if c not in ("_id", "_ord")]
    head = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("_id").alias("_id")).alias("index")))
    return docs.select(F.concat_ws("\n", head, F.to_json(F.struct(*fields))).alias("value"))
