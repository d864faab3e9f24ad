"""Near-duplicate detection: a multi-index Hamming join of b-bit MinHash signatures (operator 4).

A document's set holds the hashes of its distinct shingles of ``SHINGLE`` words; two documents are linked
when 100 * intersection >= percent * union, decided on the full sets. The threshold is a parameter
(85 if not given), from which ``plan`` derives the numbers of chunks and values; those below are for 85.

1. One scan gives each document its set's size, a 64-bit set identity and ``CHUNKS * WIDTH`` MinHash
   values of 16 bits. Documents of equal sets are one node from here on.
2. Pigeonhole: the values form ``CHUNKS`` chunks. A pair that differs in fewer than 2 * CHUNKS values has a
   chunk with at most one difference, so each chunk is emitted once for each position left out, and all
   pairs under that signature distance meet in a bucket. At a similarity of exactly 0.85, where the distance
   varies, a pair is missed with probability (1 - 0.717)**8, about 4 in 100 000; at 0.9, 3 in 10 million.
3. A bucket's nodes, sorted by size, fall into runs in which neighbours are not too different in size for a link.
   Each run gives a star: so buckets give as many edges as they have members, not their square, and
   the components of these edges (clusters) hold every pair that met.
4. Within a cluster all nodes are compared on their full sets, by an inverted index of their shingles: counts of
   shared shingles are sums over shingles, frequent ones as matrix products, rare ones by their postings. Of the links
   found only a spanning forest leaves the task, so no non-link and no further link is ever a row.
   Clusters beyond ``NODES`` nodes or ``TOKENS`` shingles are cut into parts: each part is compared in itself; scouts
   of the parts' largest components with each other; then what is still outside the cluster's largest
   component with all parts. Each is a task of two parts at most.

Components of clusters and of links come from alternating large-star and small-star steps.

Scale: keys (24 bytes each) and the texts of nodes in clusters are shuffled. Copies collapse by a partial
aggregate before anything is paired, and rows of texts with very many copies get their result by a broadcast of at
most ``HOT`` rows. A bucket with a third of all nodes is split by salt; its parts' runs meet in a
second, small round. Nothing about single documents comes to the driver. The comparison within a cluster that is not
linked up grows with the square of its nodes, in arithmetic but not in rows; texts that are linked are compared
once a part.

Defined results: words are separated by space, tab, line feed, vertical tab, form feed and carriage
return; A-Z are lower-cased. With fewer words than a shingle the whole sequence is one shingle. Null,
empty and blank texts have no shingles, are linked with nothing and kept; very long ones are compared whole. Of
repeated doc_ids the rows are judged each by its own text. A null doc_id is never a component's if another of it
is known; where it is the row's own, the row is kept. doc_id may be of any type with an order; other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import NOT_SPACE, Words, as_signed, blocks, drop_staged, mix, small, staged

SHINGLE = 5
PERCENT = 85
#: Most MinHash values of 16 bits, each of which is left out of one key, and how often a pair at the threshold may have no key in common.
MOST_VALUES, MISSED = 60, 5e-5


class Plan(NamedTuple):
    """What follows from the threshold: the keys' chunks and their width."""

    percent: int
    chunks: int
    width: int


def plan(percent: int) -> Plan:
    """The longest chunks with which at most ``MOST_VALUES`` values miss fewer than ``MISSED`` of the pairs at the threshold."""
    if not 0 < percent <= 100:
        raise ValueError("the similarity is a whole number of per cent from 1 to 100")
    j = percent / 100
    for width in range(7, 1, -1):
        meet = j**width + width * j ** (width - 1) * (1 - j)
        chunks = 1 if meet >= 1 else math.ceil(math.log(MISSED) / math.log(1 - meet))
        if chunks * width <= MOST_VALUES:
            return Plan(percent, chunks, width)
    raise ValueError(f"{MOST_VALUES} values are too few for a similarity of {percent} %")


PLAN = plan(PERCENT)
CHUNKS, WIDTH = PLAN.chunks, PLAN.width
VALUES = CHUNKS * WIDTH
#: Nodes of one part of a salted bucket, if a third of all nodes shared it (24 bytes each).
PART = 2_000_000
#: Nodes and shingles of one part of a cluster, and members of its largest component that are compared with other parts'.
NODES, TOKENS, SCOUTS = 4096, 1 << 20, 32
#: Bits of the filter for documents whose texts are compared.
BITS = 1 << 24
#: A text with more than one in so many rows is looked up by broadcast; there are at most so many of them.
HOT = 1000

_SEEDS = mix(np.arange(1, MOST_VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_STEPS = mix(np.arange(2001, 2001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(parts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of several texts."""
    words = Words(parts, NOT_SPACE)
    h, out = words.hashes(), []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - SHINGLE + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            rolled += h[k : k + n] * _STEPS[k]
        rolled = mix(rolled)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * _STEPS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_identity(s: np.ndarray) -> int:
    """A 64-bit identity of a set of hashes."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        return int(as_signed(mix(np.array([s.sum() * np.uint64(0x2545F4914F6CDD1D) + a + np.uint64(len(s))], np.uint64)))[0])


def signature(s: np.ndarray, values: int = VALUES) -> bytes:
    """MinHash values of 16 bits."""
    with np.errstate(over="ignore"):
        least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 4096):
            np.minimum(least, (s[None, at : at + 4096] * _SEEDS[:values, None]).min(axis=1), out=least)
        return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def _described(values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, ids, sigs = [], [], []
            for _, parts in blocks(batch.column(2).to_pylist()):
                for s in shingle_sets(parts):
                    sizes.append(len(s))
                    ids.append(set_identity(s) if len(s) else None)
                    sigs.append(signature(s, values) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "sid", "sig"],
            )

    return run


def describe(docs: DataFrame, values: int = VALUES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sid, sig) of ``docs`` (doc_id, text); the last two are null without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_described(values), f"doc_id {kind}, text_hash long, n_shingles long, sid long, sig binary")


# ---------------------------------------------------------------- buckets and clusters


def _keys(n_salts: int, of: Plan = PLAN):
    """(key, salt, sid, n) for each chunk and each position left out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = of.chunks * of.width
        factors = mix(np.arange(1001, 1001 + values, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            sid = np.array(batch.column(0).to_pylist(), np.int64)
            n = np.array(batch.column(1).to_pylist(), np.int32)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, values).astype(np.uint64)
            with np.errstate(over="ignore"):
                terms = (sig + np.uint64(1)) * factors
                terms = mix(terms).reshape(-1, of.chunks, of.width)
                left_out = terms.sum(axis=2, keepdims=True) - terms
                place = np.arange(values, dtype=np.uint64).reshape(1, of.chunks, of.width)
                key = as_signed(mix(left_out + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1))
            each = values
            salt = (mix(sid.view(np.uint64)) % np.uint64(n_salts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(salt, each)), pa.array(np.repeat(sid, each)), pa.array(np.repeat(n, each))], names=["key", "salt", "sid", "n"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal leading columns, from sorted batches; a table may hold several."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = np.ones(table.num_rows, bool)
        for c in table.columns[:key_columns]:
            c = c.to_numpy()
            last &= c == c[-1]
        cut = len(last) - (len(last) if last.all() else int(np.argmin(last[::-1])))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


_EDGES = "kind int, key long, a long, b long, lo int, hi int"


def _edges(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (key, a, b, lo, hi))], names=[c.split()[0] for c in _EDGES.split(", ")])


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct edges, smaller end first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    none = np.zeros(int(new.sum()), np.int32)
    return _edges(0, none.astype(np.int64), a[new], b[new], none, none)


def _runs(final: bool, percent: int):
    """From rows sorted by key, salt and size: a star for each run of sizes (kind 0) and, unless final, each run's leader and sizes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            key, salt, sid, n = (c.to_numpy() for c in table.columns)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            leader = np.minimum.reduceat(sid, first)
            yield _stars(np.repeat(leader, size), sid)
            if not final:
                yield _edges(1, key[first], leader, leader, n[first], n[first + size - 1])

    return run


def _joined_runs(percent: int):
    """Stars between the runs of a key's salts, from rows (key, lo, hi, a) sorted by key and lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            key, lo, hi, a = (c.to_numpy() for c in table.columns)
            own = np.cumsum(np.append(False, key[1:] != key[:-1]))
            upto = np.maximum.accumulate(hi + own * (1 << 32)) - own * (1 << 32)  # the largest size of a key's runs so far
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (100 * upto[:-1] < percent * lo[1:].astype(np.int64))
            first = np.flatnonzero(new)
            leader = np.minimum.reduceat(a, first)
            yield _stars(np.repeat(leader, np.diff(np.append(first, len(key)))), a)

    return run


def _met(nodes: DataFrame, part: int, of: Plan) -> DataFrame:
    """Edges (a, b) whose components hold every pair of nodes that share a bucket and are not too different in size."""
    n_salts = max(1, -(-nodes.count() // (3 * part)))
    keys = nodes.select("sid", "n", "sig").mapInArrow(_keys(n_salts, of), "key long, salt int, sid long, n int")
    found = keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "n").mapInArrow(_runs(n_salts == 1, of.percent), _EDGES)
    if n_salts == 1:
        return found.select("a", "b")
    found = staged(found, "runs")
    runs = found.filter("kind = 1").select("key", "lo", "hi", "a").repartition("key").sortWithinPartitions("key", "lo")
    return found.filter("kind = 0").select("a", "b").unionAll(runs.mapInArrow(_joined_runs(of.percent), _EDGES).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node reachable. Large-star and small-star steps."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        before, edges = edges, staged(small_star.filter("u <> v").distinct(), "edges")
        drop_staged(before)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == state:
            break
        state = now
    # A star: every node has one edge, to its label.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# ---------------------------------------------------------------- links within a cluster


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``."""
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    known, token = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    in_a, in_b = token[: len(of_a)], token[len(of_a) :]
    n_a, n_b = np.bincount(in_a, minlength=len(known)), np.bincount(in_b, minlength=len(known))
    work = n_a * n_b
    often = work * 64 >= len(a) * len(b)  # there a matrix product is cheaper than going through the postings
    out = np.zeros((len(a), len(b)), np.float32)
    often &= work > 0
    place = np.full(len(known), -1)
    columns = np.flatnonzero(often)
    for at in range(0, len(columns), 4096):
        some = columns[at : at + 4096]
        place[some] = np.arange(len(some))
        x, y = (np.zeros((len(s), len(some)), np.float32) for s in (a, b))
        for matrix, rows, tokens in ((x, of_a, in_a), (y, of_b, in_b)):
            here = place[tokens] >= 0
            matrix[rows[here], place[tokens[here]]] = 1
        out += x @ y.T
        place[some] = -1
    rest = np.flatnonzero((work > 0)[in_a] & ~often[in_a])
    order = np.argsort(in_b, kind="stable")
    start = np.cumsum(n_b) - n_b
    reps = n_b[in_a[rest]]
    upto = np.cumsum(reps)
    at = 0
    while at < len(rest):  # about four million postings at a time
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (4 << 20), "right")))
        r, tokens = reps[at:end], in_a[rest[at:end]]
        inner = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
        code = np.repeat(of_a[rest[at:end]] * len(b), r) + of_b[order[np.repeat(start[tokens], r) + inner]]
        pair, n = np.unique(code, return_counts=True)
        out.reshape(-1)[pair] += n
        at = end
    return out


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of links that connect all that ``linked`` connects: a forest, breadth first."""
    rows, cols = [], []
    new_a, new_b = linked.any(axis=1), linked.any(axis=0)
    for s in np.flatnonzero(new_a).tolist():
        if not new_a[s]:
            continue
        new_a[s] = False
        front = np.array([s])
        while len(front):
            some = linked[front]
            to = np.flatnonzero(some.any(axis=0) & new_b)
            if not len(to):
                break
            new_b[to] = False
            rows.append(front[some[:, to].argmax(axis=0)])
            cols.append(to)
            some = linked[:, to]
            front = np.flatnonzero(some.any(axis=1) & new_a)
            new_a[front] = False
            rows.append(front)
            cols.append(to[some[front].argmax(axis=1)])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_between(a: list[np.ndarray], b: list[np.ndarray], percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets in ``a`` and ``b`` that connect all links; with ``same``, ``b`` is ``a`` and no set is linked to itself."""
    shared = shared_counts(a, b)
    n_a, n_b = (np.array([len(s) for s in x], np.float32) for x in (a, b))
    linked = np.empty(shared.shape, bool)
    for at in range(0, len(a), 256):  # whole numbers below 2**24 are exact here
        c = shared[at : at + 256]
        linked[at : at + 256] = (100 + percent) * c.astype(np.float64) >= percent * (n_a[at : at + 256, None] + n_b[None, :]).astype(np.float64)
    if same:
        np.fill_diagonal(linked, False)
    return spanning(linked)


def _once(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[pa.RecordBatch]:
    """Drops rows whose leading columns repeat those of the row before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, bool)
            for k, c in enumerate(batch.columns[:key_columns]):
                c = c.to_numpy()
                new[1:] |= c[1:] != c[:-1]
                new[0] |= last is None or c[0] != last[k]
            last = [c[-1].as_py() for c in batch.columns[:key_columns]]
            yield batch.filter(pa.array(new))


def _linked(percent: int):
    """A spanning forest of the links of each comparison, from rows (cluster, i, j, side, sid, text) sorted by the first five.

    Rows of side 1 are compared with those of side 2, and those of side 0 among each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(_once(small(batches), 5), 3):
            cluster, i, j, side, sid = (c.to_numpy() for c in table.columns[:5])
            sets = [s for _, parts in blocks(table.column(5).to_pylist()) for s in shingle_sets(parts)]
            edge = np.flatnonzero(np.append(True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            out_a, out_b = [], []
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(sid)]):
                own = np.arange(lo, hi)
                a, b = own[side[own] != 2], own[side[own] != 1]
                if len(a) and len(b):
                    x, y = links_between([sets[k] for k in a], [sets[k] for k in b], percent, bool((side[own] == 0).all()))
                    out_a.append(sid[a[x]])
                    out_b.append(sid[b[y]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


_ROWS = ("cluster", "i", "j", "side", "sid", "text")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select(*_ROWS).repartition("cluster", "i", "j").sortWithinPartitions(*_ROWS[:5]).mapInArrow(_linked(percent), "a long, b long")


def _marked(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``rep`` shares its bit with that of a member: few others than the members' own.

    The bits have a fixed size (2 MB), so all tasks may get them; more members than bits only mean more rows for the join to drop.
    """
    place = lambda: F.pmod(F.xxhash64("rep"), F.lit(BITS))
    bits = members.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    rows = docs.withColumn("p", place()).join(F.broadcast(bits), F.bitmap_bucket_number("p") == F.col("page"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def _links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, percent: int, most: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) whose components are those of all links within clusters (node, label), and the staged tables behind them."""
    members = clusters.select(F.col("node").alias("sid"), F.col("label").alias("cluster")).join(nodes.select("sid", "rep", "n"), "sid")
    parts = F.greatest(F.ceil(F.count("*") / most[0]), F.ceil(F.sum("n") / most[1])).cast("int")
    members = staged(members.join(members.groupBy("cluster").agg(parts.alias("parts")), "cluster").withColumn("part", F.pmod(F.hash("sid"), F.col("parts"))), "members")
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("text_hash"))
    texts = _marked(docs.select(own.alias("rep"), "text"), members)
    with_text = lambda some: texts.join(some.hint("merge"), "rep")
    zero = F.lit(0)
    links = [staged(_compared(with_text(members).select("*", F.col("part").alias("i"), F.col("part").alias("j"), zero.alias("side")), percent), "links")]
    big = members.filter("parts > 1")
    if not big.isEmpty():
        label = lambda: components(reduce(DataFrame.unionAll, links))
        named = big.join(label().withColumnsRenamed({"node": "sid", "label": "own"}), "sid", "left").withColumn("own", F.coalesce("own", "sid"))
        largest = Window.partitionBy("cluster", "part").orderBy(F.desc("m"), "own")
        top = named.groupBy("cluster", "part", "own").agg(F.count("*").alias("m")).withColumn("k", F.row_number().over(largest)).filter("k = 1").select("cluster", "part", "own")
        first = Window.partitionBy("cluster", "part").orderBy("sid")
        scouts = named.join(top, ["cluster", "part", "own"]).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SCOUTS)
        group = F.floor(F.col("part") / max(2, most[0] // SCOUTS)).cast("int")
        links.append(staged(_compared(with_text(scouts.select("sid", "rep", "cluster", group.alias("i"))).select("*", F.lit(-1).alias("j"), zero.alias("side")), percent), "links"))
        named = staged(big.join(label().withColumnsRenamed({"node": "sid", "label": "own"}), "sid", "left").withColumn("own", F.coalesce("own", "sid")), "named")
        top = named.groupBy("cluster", "own").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("own", F.struct("m", "own")).alias("most"))
        named = named.join(top, "cluster").withColumn("outside", F.col("own") != F.col("most"))
        # Nodes outside the largest component, dealt to as few parts as hold them, meet all parts.
        out = named.filter("outside").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / most[0]), F.ceil(F.sum("n") / most[1])).cast("int").alias("groups"))
        named = named.join(out, "cluster")
        rest = named.filter("outside").select("sid", "rep", "cluster", F.pmod(F.hash("sid", zero), F.col("groups")).alias("i"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("j"), F.lit(1).alias("side"))
        whole = named.select("sid", "rep", "cluster", F.explode(F.sequence(zero, F.col("groups") - 1)).alias("i"), F.col("part").alias("j"), F.lit(2).alias("side"))
        links.append(staged(_compared(with_text(rest.unionAll(whole)), percent), "links"))
    return reduce(DataFrame.unionAll, links), [members, *links]


# ---------------------------------------------------------------- results


def near_duplicates(docs: DataFrame, part: int = PART, percent: int = PERCENT, most: tuple[int, int] = (NODES, TOKENS)) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, chosen) of ``docs`` (doc_id, text), linked from a similarity of ``percent`` on.

    ``kept`` says that the row has its class's smallest doc_id. ``text_hash`` is Spark's xxhash64 of the text: with doc_id it
    tells rows apart, and ``chosen`` is true for one such pair of each class, even where doc_ids repeat or are null.
    """
    how = plan(percent)
    docs = docs.select("doc_id", "text")
    about = staged(describe(docs, how.chunks * how.width), "signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    nodes = staged(
        about.filter("sid is not null").groupBy("sid")
        .agg(F.min(rep).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").cast("int").alias("n"), F.first("sig").alias("sig")), "nodes"
    )
    clusters = staged(components(_met(nodes, part, how)), "clusters")
    links, made = _links(docs, nodes, clusters, percent, most)
    labels = staged(components(links), "labels")
    classes = staged(_classes(nodes, labels), "classes")
    drop_staged(*made, clusters, labels, nodes)
    return _labelled(about, classes)


def _classes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(sid, copies, first) of every node; ``first`` (unknown, doc_id, text_hash) is its class's smallest row, known doc_ids before null."""
    named = nodes.select("sid", "copies", "rep").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    return named.join(named.groupBy("label").agg(F.min("rep").alias("first")), "label").select("sid", "copies", "first")


def _labelled(about: DataFrame, of_node: DataFrame) -> DataFrame:
    """A row for each of ``about``."""
    n = about.count()
    hot = of_node.filter(F.col("copies") * HOT > n).select(F.col("sid").alias("hot_sid"), F.col("first").alias("hot_first"))  # fewer than HOT rows
    found = about.drop("sig").join(F.broadcast(hot), F.col("sid") == F.col("hot_sid"), "left")
    # A row that has its result already, or has no set, takes any place in the shuffle.
    key = F.when(F.col("hot_sid").isNull() & F.col("sid").isNotNull(), F.col("sid")).otherwise(F.xxhash64("doc_id", "text_hash"))
    cold = of_node.filter(F.col("copies") * HOT <= n).select(F.col("sid").alias("key"), F.col("sid").alias("cold_sid"), F.col("first").alias("cold_first"))
    found = found.withColumn("key", key).join(cold, "key", "left")
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    first = F.when(F.col("hot_sid").isNotNull(), F.col("hot_first")).when(F.col("cold_sid") == F.col("sid"), F.col("cold_first")).otherwise(own)
    found = found.select("doc_id", "text_hash", "n_shingles", own.alias("own"), first.alias("first"))
    return found.select(
        "doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"), (F.col("own") == F.col("first")).alias("chosen"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85).drop("text_hash", "chosen")
