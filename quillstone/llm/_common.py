"""Helpers that several operators share: staging folders, text clean-up, byte-level word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage for good."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in frames:
        drop_dir(df.sparkSession, df.staged_at)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not among ``columns``, in any case of letters."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a staged folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of a filter of keys: fixed (2 MB), so all tasks may get it; more keys only mean that it lets more through.
BITS = 1 << 24


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes in which bit ``key & (BITS - 1)`` is set for every key."""
    place = F.pmod(F.col(column), F.lit(BITS)) + 1
    pages = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(BITS >> 3, np.uint8)
    for r in pages.collect():  # at most 512 rows of 4 KB
        at = (r["page"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


# ---------------------------------------------------------------- bounded memory in workers


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that a worker holds few rows as Python objects; freed memory goes back to the system afterwards."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        release()


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of few rows for what is executed inside: by default a whole partition is one batch, held by Spark and by the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give freed memory back: workers live on between stages, and the allocator would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


# ---------------------------------------------------------------- hashing of words in whole byte buffers

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INV = pow(_STEP, -1, 1 << 64)


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = np.array([_mix_int(i + 1) for i in range(256)], dtype=np.uint64)
_BLOCK = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, _BLOCK + 1), _STEP if kind == "up" else _STEP_INV, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _POWERS[kind] = have
    return have


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which ``inside[byte]`` holds."""
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = inside[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any span of ``data`` follows."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _powers("up", len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each span; equal bytes give equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * _powers("down", len(sums))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of words as the shingle contract has them: all but the six white-space characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: A-Z to a-z on bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def blocks(texts: list[str | None], limit: int = _BLOCK):
    """Yield (first row, rows as UTF-8) so that a block has about ``limit`` bytes; a null text is empty."""
    at, parts, total = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if parts and total + len(b) > limit:
            yield at, parts
            at, parts, total = i, [], 0
        parts.append(b)
        total += len(b) + 1
    if parts:
        yield at, parts


class Words:
    """The words of several texts at once: ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    def __init__(self, parts: list[bytes], inside: np.ndarray):
        self.data = FOLD[np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)]
        self.starts, self.ends = word_spans(self.data, inside)
        self.offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.sums = prefix_sums(self.data)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.sums, self.starts if starts is None else starts, self.ends if ends is None else ends)


def as_signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed ones."""
    return h.view(np.int64)
