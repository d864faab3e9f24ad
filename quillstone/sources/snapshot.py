"""Snapshots: documents as Parquet with a JSON manifest, and a lifecycle for them."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans.dsl import QueryError

FORMAT = 1


class Repository:
    """Snapshots below one path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self, name: str) -> dict | None:
        fs, p = self._file(f"{name}/manifest")
        return json.loads(self.spark.read.text(f"{self.path}/{name}/manifest").first()[0]) if fs.exists(p) else None

    def create(self, engine, name: str, target: str | None = None) -> dict:
        """Write the documents, mappings, settings and aliases of a target or of everything; names are not reused."""
        if self._manifest(name):
            raise QueryError(f"snapshot [{name}] already exists", 400, "invalid_snapshot_name_exception")
        chosen = engine.resolve(target) if target else [engine.indices[n] for n in sorted(engine.indices)]
        info = {"format": FORMAT, "snapshot": name, "created": dt.datetime.now(dt.UTC).isoformat(), "indices": {}}
        for i in chosen:
            i.docs.write.parquet(f"{self.path}/{name}/indices/{i.name}")
            info["indices"][i.name] = {
                "mappings": i.mapping.body(), "settings": i.settings, "aliases": {a: m[i.name] for a, m in engine.aliases.items() if i.name in m},
            }
        self.spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{self.path}/{name}/manifest")  # last: a snapshot without it is not there
        return info

    def list(self) -> list[str]:
        fs, p = self._file("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self._manifest(s.getPath().getName())) if fs.exists(p) else []

    def get(self, name: str) -> dict:
        found = self._manifest(name)
        if not found:
            raise QueryError(f"snapshot [{name}] is missing", 404, "snapshot_missing_exception")
        return found

    def restore(self, engine, name: str, indices: list[str] | None = None) -> list[str]:
        """Bring back all or some indices; existing ones are never overwritten."""
        info = self.get(name)
        if info["format"] != FORMAT:
            raise QueryError(f"snapshot format [{info['format']}] is not supported")
        chosen = indices or sorted(info["indices"])
        for i in chosen:
            if i not in info["indices"]:
                raise QueryError(f"index [{i}] is not in snapshot [{name}]", 404, "index_not_found_exception")
            if i in engine.indices:
                raise QueryError(f"index [{i}] exists already", 400, "snapshot_restore_exception")
        for i in chosen:
            spec = info["indices"][i]
            body = {"mappings": spec["mappings"], "settings": spec["settings"], "aliases": spec["aliases"]}
            engine.create(i, body, self.spark.read.parquet(f"{self.path}/{name}/indices/{i}"))
        return chosen

    def delete(self, name: str) -> None:
        self.get(name)
        fs, p = self._file(name)
        fs.delete(p, True)

    def verify(self, name: str) -> bool:
        """Every index of the manifest can be read."""
        return all(self.spark.read.parquet(f"{self.path}/{name}/indices/{i}").schema for i in self.get(name)["indices"])


def export_index(engine, name: str, path: str) -> None:
    """One index as lines of JSON documents, with its mapping, settings and aliases in a manifest."""
    i = engine.resolve(name)[0]
    fields = [c for c in i.docs.columns if not c.startswith("_")]
    i.docs.select(F.to_json(F.struct("_ord", "_id", F.struct(*fields).alias("_source"))).alias("value")).write.text(f"{path}/documents")
    info = {"format": FORMAT, "index": i.name, "mappings": i.mapping.body(), "settings": i.settings, "aliases": {a: m[i.name] for a, m in engine.aliases.items() if i.name in m}, "schema": i.docs.schema.json()}
    engine.spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{path}/manifest")  # last: without it there is no export


def import_index(engine, path: str, name: str | None = None) -> str:
    """Bring back an exported index, under another name if given; an existing one is never overwritten."""
    info = json.loads(engine.spark.read.text(f"{path}/manifest").first()[0])
    if info.get("format") != FORMAT:
        raise QueryError(f"format [{info.get('format')}] is not supported")
    schema = T.StructType.fromJson(json.loads(info["schema"]))
    fields = [f for f in schema.fields if not f.name.startswith("_")]
    line = T.StructType([schema["_ord"], schema["_id"], T.StructField("_source", T.StructType(fields))])
    docs = engine.spark.read.schema(line).json(f"{path}/documents").select("_ord", "_id", *[F.col("_source")[f.name].alias(f.name) for f in fields])
    return engine.create(name or info["index"], {k: info[k] for k in ("mappings", "settings", "aliases")}, docs).name


# ---------------------------------------------------------------- lifecycle


@dataclass
class Policy:
    name: str
    schedule: str
    pattern: str = "<snap-{now/d}>"
    max_count: int | None = None
    min_count: int = 0
    expire_after: dt.timedelta | None = None
    log: list[dict] = field(default_factory=list)


def cron_matches(expression: str, at: dt.datetime) -> bool:
    """Minute, hour, day of month, month, day of week (Sunday 0 or 7); six fields start with seconds."""
    parts = expression.split()
    if len(parts) == 6:
        parts = parts[1:]
    if len(parts) != 5:
        raise ValueError(f"bad schedule [{expression}]")
    values = (at.minute, at.hour, at.day, at.month, at.isoweekday() % 7)
    limits = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))

    def one(spec: str, value: int, low: int, high: int) -> bool:
        for item in spec.split(","):
            base, _, step = item.partition("/")
            if base in ("*", "?"):
                a, b = low, high
            elif m := re.fullmatch(r"(\d+)(?:-(\d+))?", base):
                a = int(m[1])
                b = int(m[2]) if m[2] else (high if step else a)
            else:
                raise ValueError(f"bad schedule [{expression}]")
            if not low <= a <= b <= high:
                raise ValueError(f"bad schedule [{expression}]")
            chosen = range(a, b + 1, int(step or 1))
            if value in chosen or (high == 7 and value == 0 and 7 in chosen):
                return True
        return False

    return all([one(s, v, *l) for s, v, l in zip(parts, values, limits)])


def next_run(expression: str, after: dt.datetime) -> dt.datetime:
    at = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(366 * 24 * 60 * 4):
        if cron_matches(expression, at):
            return at
        at += dt.timedelta(minutes=1)
    raise ValueError(f"schedule [{expression}] never runs")


def snapshot_name(pattern: str, at: dt.datetime) -> str:
    """``<name-{now/d}>`` with the day filled in; plain names as they are."""
    m = re.fullmatch(r"<(.*)>", pattern)
    unit = {"d": "%Y.%m.%d", "M": "%Y.%m", "y": "%Y", "h": "%Y.%m.%d.%H"}
    return re.sub(r"\{now(?:/([dMyh]))?\}", lambda x: at.strftime(unit[x[1] or "d"]), m[1]) if m else pattern


def expired(policy: Policy, snapshots: list[tuple[str, dt.datetime]], now: dt.datetime) -> list[str]:
    """Snapshots to delete, oldest first: too old or too many, but never below ``min_count``."""
    rows = sorted(snapshots, key=lambda x: x[1])
    out = []
    for name, made in rows:
        left = len(rows) - len(out)
        old = policy.expire_after is not None and now - made > policy.expire_after
        many = policy.max_count is not None and left > policy.max_count
        if (old or many) and left > policy.min_count:
            out.append(name)
    return out


def run_policy(policy: Policy, repository: Repository, engine, now: dt.datetime) -> dict:
    """Take a snapshot, apply retention, keep the last hundred log entries."""
    name = f"{snapshot_name(policy.pattern, now)}-{now:%H%M%S}"
    repository.create(engine, name)
    made = [(n, dt.datetime.fromisoformat(repository.get(n)["created"])) for n in repository.list()]
    gone = expired(policy, made, now)
    for n in gone:
        repository.delete(n)
    entry = {"policy": policy.name, "at": now.isoformat(), "snapshot": name, "deleted": gone}
    policy.log = [*policy.log, entry][-100:]
    return entry
