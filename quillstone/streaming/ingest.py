"""Streaming ingestion: micro-batches of bulk lines kept as a log of operations, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import bulk


def upsert_stream(lines: DataFrame, table: str, schema: str, checkpoint: str):
    """Keep a stream of (seq, action, _id, source JSON) as ``<table>/ops/b=<batch>``; ``schema`` is that of the source.

    A batch writes its own operations and nothing else, and the same files if it is run again. ``latest`` puts the
    operations of all batches in the order of ``seq``, so it does not matter in which batch one arrives.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ops = rows.withColumn("s", F.from_json("source", schema)).select("seq", "action", "_id", "s.*")
        ops.write.mode("overwrite").parquet(f"{table}/ops/b={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``<prefix><number>`` below a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]
    return sorted(int(n.getName()[len(prefix) :]) for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The table after all operations: the newest compacted state, and what came with a later ``seq``."""
    batches, states = _versions(spark, f"{table}/ops", "b="), _versions(spark, f"{table}/state", "upto=")
    if not batches and not states:
        raise ValueError(f"there is nothing at {table}")
    ops = spark.read.parquet(*[f"{table}/ops/b={b}" for b in batches]) if batches else None
    if states:
        base = spark.read.parquet(f"{table}/state/upto={states[-1]}")
        return base if ops is None else bulk.apply(base, ops.filter(F.col("seq") > states[-1]))
    fields = [f for f in ops.schema.fields if f.name not in ("seq", "action", "_id")]
    empty = spark.createDataFrame([], "_ord long, _id string").select("_ord", "_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return bulk.apply(empty, ops)


def compact(spark: SparkSession, table: str, upto: int) -> DataFrame:
    """Fold the operations up to ``upto`` into a state, so that ``latest`` reads fewer; any that still arrive below it are ignored."""
    states = _versions(spark, f"{table}/state", "upto=")
    ops = spark.read.parquet(*[f"{table}/ops/b={b}" for b in _versions(spark, f"{table}/ops", "b=")]).filter(F.col("seq") <= upto)
    if states:
        state = bulk.apply(spark.read.parquet(f"{table}/state/upto={states[-1]}"), ops.filter(F.col("seq") > states[-1]))
    else:
        fields = [f for f in ops.schema.fields if f.name not in ("seq", "action", "_id")]
        state = bulk.apply(spark.createDataFrame([], "_ord long, _id string").select("_ord", "_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]), ops)
    state.write.mode("overwrite").parquet(f"{table}/state/upto={upto}")
    return spark.read.parquet(f"{table}/state/upto={upto}")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key in tumbling event-time windows, for streams and tables alike; late rows are dropped beyond the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
