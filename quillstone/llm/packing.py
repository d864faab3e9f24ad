"""Best-fit packing of token sequences with exact-complement hashing (operator 10).

Documents become pieces of at most ``capacity`` tokens. Planning sees only how many pieces each length
has, at most ``capacity`` numbers whatever the corpus: single, pair and triple sums of the lengths still
available are looked up for exact complements of a gap and consumed under their counts; what remains is
packed best-fit, longest first. The plan is a short list of patterns with multiplicities, so its size is
bounded by ``capacity``, never by the data, and it may go to every task.

Pieces then take their places by rank within their length. Ranks come from two levels, a hash bucket
within the length and the counts of the buckets before it, so no task holds all pieces of a common length.

Defined results: a null or empty text is one piece, the end id alone; a very long one is cut whole. Repeated
rows and doc_ids, null ones too, each get places (their order follows the ids' checksum, and is arbitrary among
identical pieces). Columns ``sequence_id`` and ``offset`` of the input give way; others pass. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import small, staged, unused
from ._encode import encoder

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"


# ---------------------------------------------------------------- the plan, from counts alone


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; ``counts[l]`` pieces have length ``l``.

    Exact triples can use up the short pieces that best fit would spread better, so plans with complements
    of up to three, two, one and no lengths are compared and the shortest is kept, of equals the deepest.
    """
    least = -(-int(np.dot(counts, np.arange(len(counts)))) // capacity)
    best, fewest = [], None
    for depth in (3, 2, 1, 0):
        plan = _complements(counts, capacity, depth)
        n = sum(m for _, m in plan)
        if fewest is None or n < fewest:
            best, fewest = plan, n
        if fewest == least:
            break
    return best


def _complements(counts: np.ndarray, capacity: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: len(counts)] = counts
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        """Take a pattern as often as its lengths are available."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                left[x] -= k * n
            plan.append((lengths, n))
        return n > 0

    for big in range(capacity, 0, -1) if depth else ():
        if not left[big]:
            continue
        gap = capacity - big
        if not gap:
            use((big,))
            continue
        use((big, gap))  # single complements
        if left[big] and depth > 1:  # pair sums: a + b = gap
            a = np.arange(1, gap // 2 + 1)
            for x in a[(left[a] > 0) & (left[gap - a] > 0)][::-1].tolist():
                if not left[big]:
                    break
                use((big, gap - x, x))
        if left[big] and depth > 2:  # triple sums: a + b + c = gap
            for x in range(gap - 2, 0, -1):
                if not left[big]:
                    break
                if not left[x]:
                    continue
                rest = gap - x
                a = np.arange(1, rest // 2 + 1)
                for y in a[(left[a] > 0) & (left[rest - a] > 0)][::-1].tolist():
                    if not left[big] or not left[x]:
                        break
                    use((big, x, rest - y, y))
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on groups of equal bins: gap -> [(lengths, how many such bins)]."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        gap = length
        while todo and gap < capacity:
            groups = bins.get(gap)
            if not groups:
                gap += 1
                continue
            lengths, n = groups.pop()
            k = min(n, todo)
            if n > k:
                groups.append((lengths, n - k))
            todo -= k
            bins.setdefault(gap - length, []).append((lengths + (length,), k))
            gap = length  # a bin that just took one may still be the tightest
        each = capacity // length
        full, rest = divmod(todo, each)
        if full:
            bins.setdefault(capacity - each * length, []).append(((length,) * each, full))
        if rest:
            bins.setdefault(capacity - rest * length, []).append(((length,) * rest, 1))
    return [g for groups in bins.values() for g in groups]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each run, first sequence of the run, offset in the sequence)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((int(used[x]), sequence, at))
            used[x] += n
            at += x
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


# ---------------------------------------------------------------- pieces


def _pieces(tokenizer: str, end: int, capacity: int):
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in small(batches):
            ids, bounds = enc.batch(batch.column(1).to_pylist(), end)
            n = np.diff(bounds)
            count = -(-n // capacity)
            upto = np.cumsum(count)
            of = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(of)) - np.repeat(upto - count, count)
            head = n - (count - 1) * capacity  # only the first may be shorter
            start = np.where(number > 0, head[of] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head[of])
            data, at = memoryview(ids.tobytes()), 4 * (bounds[of] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row (with ``length`` and ``doc_id``) a ``sequence_id`` and an ``offset``; ``rows`` must be stored data."""
    rows = rows.drop("sequence_id", "offset")
    bucket, inner, earlier, number, rank = (unused(f"__{x}", rows.columns) for x in ("bucket", "in", "before", "n", "rank"))
    # At most `capacity` rows: a histogram of lengths.
    have = rows.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in have:
        counts[r["length"]] = r["count"]
    table = slots(plan_patterns(counts, capacity), capacity)
    n_buckets = max(16, math.isqrt(int(counts.sum())))
    order = ["doc_id", "piece", "ids_crc32"]
    local = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    ranked = local.withColumn(inner, F.row_number().over(Window.partitionBy("length", bucket).orderBy(*order)) - 1)
    before = (
        local.groupBy("length", bucket).agg(F.count("*").alias(number))
        .withColumn(earlier, F.sum(number).over(Window.partitionBy("length").orderBy(bucket)) - F.col(number)).drop(number)
    )
    spots = ranked.join(before, ["length", bucket]).withColumn(rank, F.col(earlier) + F.col(inner)).drop(bucket, inner, earlier)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, ranks = b.column("length").to_numpy(), b.column(rank).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    first, base, place_at = table[int(length[at[0]])]
                    run = np.searchsorted(first, ranks[at], "right") - 1
                    sequence[at], offset[at] = base[run] + ranks[at] - first[run], place_at[run]
            kept = [n for n in b.schema.names if n != rank]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = spots.drop(rank).schema.fields
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in kept), "sequence_id long", "offset long"])
    return spots.mapInArrow(place, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(staged(pieces(docs), "pieces"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
