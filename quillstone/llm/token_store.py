"""Content-addressed store of token ids (operator 6).

Writing: each document's ids are cut into chunks where a rolling hash over the last ``WINDOW`` ids is the largest
of its neighbourhood, so equal passages give equal chunks wherever they stand. A chunk is stored once under
the SHA-256 of its bytes; a document is a recipe, the list of its chunks' digests, with a Merkle root
over them. Recipes are range-partitioned by doc_id; each part knows its token total, so the place of
every document in the one long stream follows from a prefix sum over parts.

Layout below the store's path: ``chunks/`` (digest, n, data: little-endian uint16, or uint32 for large
vocabularies), ``recipes/`` (doc_id, n_tokens, digests, root, part, row, local_start) in ascending doc_id
order, ``parts/`` (part, start, n_docs, n_tokens, root: a Merkle root over the part's documents in order) and
``manifest/`` (counts, and a Merkle root over all parts).

Reading back checks everything against the manifest: counts, starts and roots of the parts are recomputed from
the recipes, every recipe against its root, every chunk against its address; a chunk, recipe or part that
is missing, changed or added raises. ``documents()`` returns whole id streams. ``audit()`` combines the checked
chunks' CRC-32 values into the document's (a CRC of a concatenation follows from the parts' CRCs and lengths),
so that no payload is shuffled.

Scale: digests are dealt to buckets of about ``BUCKET_BYTES`` of input. Between tasks, the chunks of a task's documents
travel as one row a bucket; a passage with a third of all rows is sent once by every thousand documents
or so, and asked for as often. What is staged is merged by a quarter at a time and removed, so that it is not on disk whole
together with its shuffle and the chunks. Recipes carry 32 bytes a chunk. Sums over parts are rows a part, not a document.

Defined results: null and empty texts are one end id; very long ones are many chunks. Repeated doc_ids each keep
their recipe, in an order fixed by (doc_id, root); null ones come first. Other columns are not read. An empty table
gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_dir, mix, new_dir, small
from ._encode import encoder

END = 2
WINDOW = 8
#: A cut has the largest hash of so many ids on either side, so chunks have more than REACH ids and about twice as many on
#: average: they are shorter than the passages of 100 to 200 words that documents share.
REACH, MOST = 40, 2048
TOKENIZER = "word_bpe_49k.json"
#: Bytes of input (or of ids) whose chunks meet in one group, and digests that a task remembers as sent.
BUCKET_BYTES, SENT = 8 << 20, 200_000
#: Parts of the staged payload that are merged one after the other, each being removed before the next, and the name of the recipes' part.
SLABS, RECIPES = 4, -1
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Children of a node in the tree over a part's documents, and in that over a document's chunks.
FAN, CHILDREN = 256, 16


def _most_of_next(h: np.ndarray, n: int) -> np.ndarray:
    """The largest of each ``n`` neighbours ``h[i:i + n]``, by doubling."""
    have, size = h, 1
    while size < n:
        step = min(size, n - size)
        have, size = np.maximum(have[:-step], have[step:]), size + step
    return have


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document ``ids[bounds[i]:bounds[i + 1]]`` the ends of its chunks, counted from its start.

    Whether there is a cut depends on the ``REACH`` ids on either side alone, which must be the document's own.
    """
    docs = len(bounds) - 1
    out: list[list[int]] = [[] for _ in range(docs)]
    if len(ids) > 2 * REACH:
        with np.errstate(over="ignore"):
            seed = mix(ids.astype(np.uint64) + np.uint64(1))
            h = seed.copy()
            for k in range(1, WINDOW):
                h[k:] += seed[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        h = mix(h)
        most = _most_of_next(h, REACH)
        here = h[REACH:-REACH]
        where = np.flatnonzero((here > most[: len(here)]) & (here >= most[REACH + 1 :])) + REACH
        doc = np.searchsorted(bounds, where, "right") - 1
        own = (where - bounds[doc] >= REACH + WINDOW) & (bounds[doc + 1] - where > REACH)
        for d, c in zip(doc[own].tolist(), (where - bounds[doc])[own].tolist()):
            out[d].append(c)
    for ends, n in zip(out, np.diff(bounds).tolist()):
        if n:
            ends.append(n)
        if n > MOST:  # the same few ids again and again have no cut of their own
            whole, at = [], 0
            for e in ends:
                while e - at > MOST:
                    at += MOST
                    whole.append(at)
                whole.append(e)
                at = e
            ends[:] = whole
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a hash tree over digests, with up to ``CHILDREN`` children a node, and of their number."""
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + CHILDREN])).digest() for i in range(0, len(level), CHILDREN)]
    return hashlib.sha256(b"\x02" + len(digests).to_bytes(8, "little") + b"".join(level)).digest()


# ---------------------------------------------------------------- CRC-32 of concatenations

_POLY = np.uint32(0xEDB88320)


def _crc_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bit-reversed representation."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _crc_shifts(n: int, every: int = 1) -> np.ndarray:
    """For 0, every, 2 * every ... ids of four bytes (n numbers), what a CRC is multiplied with when so many ids follow it."""
    out = np.empty(n, np.uint32)
    out[0] = 0x80000000
    step = np.array([0x80000000], np.uint32)
    for _ in range(32):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), _POLY, np.uint32(0))
    power = out[:1]
    for bit in bin(every)[2:]:  # step to the power of ``every``
        power = _crc_times(power, power)
        power = _crc_times(power, step) if bit == "1" else power
    have = 1
    while have < n:  # doubling: shifts of have..2*have-1 follow from those before
        k = min(have, n - have)
        out[have : have + k] = _crc_times(out[:k], power)
        have, power = have + k, _crc_times(power, power)
    return out


_LOW = 1 << 11
_SHIFTS: list[np.ndarray] = []


def join_crcs(crcs: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The CRC-32 of each document from its chunks' CRCs and lengths in ids; document ``i`` has those of ``bounds[i]:bounds[i + 1]``, one at least.

    Each chunk's CRC is shifted by the ids after it; the document's is the XOR of these.
    """
    upto = np.cumsum(lengths)
    after = np.repeat(upto[bounds[1:] - 1], np.diff(bounds)) - upto
    if not _SHIFTS:
        _SHIFTS.extend([_crc_shifts(_LOW), _crc_shifts(_LOW, _LOW)])
    out, left = _crc_times(crcs.astype(np.uint32), _SHIFTS[0][after % _LOW]), after // _LOW
    far = np.flatnonzero(left)
    while len(far):
        out[far] = _crc_times(out[far], _SHIFTS[1][np.minimum(left[far], _LOW - 1)])
        left[far] -= np.minimum(left[far], _LOW - 1)
        far = far[left[far] > 0]
    return np.bitwise_xor.reduceat(out, bounds[:-1]) if len(out) else out


# ---------------------------------------------------------------- digests in buckets


def _bucketed(digests: list[bytes], n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its digests, or of their first bytes) for each bucket that has some."""
    if digests:
        bucket = np.frombuffer(b"".join(digests), "<u8")[:: len(digests[0]) // 8] % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[at[0]]), at


def _n_buckets(size: int) -> int:
    return max(8, -(-size // BUCKET_BYTES)) if size < 1 << 60 else 8  # a plan that does not know its size says so with a huge one


# ---------------------------------------------------------------- writing

_STAGED = "doc_id long, n_tokens long, digests array<binary>, root binary, bucket long, n binary, data binary"


def _encoded(tokenizer: str, end: int, n_buckets: int, size: int):
    """Recipes, and between them rows of new chunks by bucket: lengths (uint32) and packed payload, each joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer)
        width = np.dtype(f"<u{size}")
        sent: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in small(batches):
            ids, bounds = enc.batch(batch.column(1).to_pylist(), end)
            data = ids.astype(width).tobytes()
            lists, digests, roots, fresh = [0], [], [], []
            for start, ends in zip(bounds.tolist(), cut_points(ids, bounds)):
                a = start
                for b in ends:
                    b += start
                    d = hashlib.sha256(data[a * width.itemsize : b * width.itemsize]).digest()
                    digests.append(d)
                    if d not in sent:
                        sent.add(d)
                        fresh.append((d, a, b))
                    a = b
                roots.append(merkle(digests[lists[-1] :]))
                lists.append(len(digests))
            rows = len(roots)
            ns, payloads, buckets = [], [], []
            for bucket, at in _bucketed([f[0] for f in fresh], n_buckets):
                mine = [fresh[i] for i in at.tolist()]
                buckets.append(bucket)
                ns.append(np.array([b - a for _, a, b in mine], "<u4").tobytes())
                payloads.append(pack(b"".join(data[a * width.itemsize : b * width.itemsize] for _, a, b in mine)))
            if len(sent) > SENT:
                sent.clear()
            recipes = [batch.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(digests, pa.binary())), pa.array(roots, pa.binary())]
            chunks = [pa.array(buckets, pa.int64()), *(pa.array(x, pa.binary()) for x in (ns, payloads))]
            names = [c.split()[0] for c in _STAGED.split(", ")]
            for own, others, count, ahead in ((recipes, chunks, rows, True), (chunks, recipes, len(buckets), False)):
                nulls = [pa.nulls(count, c.type) for c in others]
                yield pa.RecordBatch.from_arrays([*own, *nulls] if ahead else [*nulls, *own], names=names)

    return run


def _merged(width: int):
    """The chunks of one bucket, each once."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sizes = np.frombuffer(b"".join(table["n"].to_pylist()), "<u4")
        data = b"".join(map(unpack, table["data"].to_pylist()))
        upto = (np.cumsum(sizes, dtype=np.int64) * width).tolist()
        chunks = {}
        for a, b in zip([0, *upto[:-1]], upto):
            chunk = data[a:b]
            chunks[hashlib.sha256(chunk).digest()] = chunk
        kept = list(chunks.values())
        return pa.table({"digest": pa.array(list(chunks), pa.binary()), "n": pa.array([len(c) // width for c in kept], pa.int32()), "data": pa.array(kept, pa.binary())})

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a part's number, the place in it and the ids before each document within it; rows arrive in doc_id order."""
    from pyspark import TaskContext

    at, row, part = 0, 0, TaskContext.get().partitionId()
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        own = [np.full(len(n), part, np.int32), row + np.arange(len(n)), at + np.cumsum(n) - n]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], names=[*b.schema.names, "part", "row", "local_start"])
        at, row = at + int(n.sum()), row + len(n)


@contextmanager
def _no_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def _staged(spark: SparkSession, path: str, slab: int) -> DataFrame:
    return spark.read.schema(f"{_STAGED}, slab int").parquet(f"{path}/staging").filter(F.col("slab") == slab)


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> dict:
    """Write a store of ``docs`` (doc_id, text) below ``path``; returns the manifest."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_buckets = _n_buckets(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    width = 2 if encoder(tokenizer).full.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    slab = F.coalesce(F.col("bucket") % SLABS, F.lit(RECIPES)).cast("int").alias("slab")
    encoded = docs.mapInArrow(_encoded(tokenizer, end, n_buckets, width), _STAGED).select("*", slab)
    encoded.write.partitionBy("slab").option("compression", "none").parquet(f"{path}/staging")  # digests and packed payload
    with _no_old_shuffles(spark):
        for i in range(SLABS):
            (
                _staged(spark, path, i).select("bucket", "n", "data").groupBy("bucket")
                .applyInArrow(_merged(width), "digest binary, n int, data binary").write.mode("append").option("compression", "zstd").parquet(f"{path}/chunks")
            )
            drop_dir(spark, f"{path}/staging/slab={i}")
        (
            _staged(spark, path, RECIPES).select("doc_id", "n_tokens", "digests", "root").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root")
            .mapInArrow(_placed, "doc_id long, n_tokens long, digests array<binary>, root binary, part int, row long, local_start long")
            .write.option("compression", "zstd").parquet(f"{path}/recipes")
        )
    drop_dir(spark, f"{path}/staging")
    parts = _parts(spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame(parts, "part int, start long, n_docs long, n_tokens long, root string").coalesce(1).write.parquet(f"{path}/parts")
    info = {"tokenizer": tokenizer, "end": end, **_totals(parts)}
    spark.createDataFrame([tuple(info.values())], "tokenizer string, end int, n_docs long, n_tokens long, root string").coalesce(1).write.json(f"{path}/manifest")
    return info


def _parts(recipes: DataFrame) -> list[tuple[int, int, int, int, str]]:
    """(part, start, n_docs, n_tokens, root) of each part, from its recipes: one row a part comes to the driver, not a document.

    The root is that of a tree over documents in order; a node has up to ``FAN`` children, so no task holds a whole part.
    """
    leaf = F.sha2(F.concat_ws("|", F.hex("root"), "doc_id", "row", "local_start", "n_tokens"), 256)
    nodes = recipes.select("part", F.col("row").alias("at"), leaf.alias("h"))
    sums = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("row").alias("last"))
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    width = max([r["last"] + 1 for r in rows], default=1)
    while True:
        nodes = nodes.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("c"))
        nodes = nodes.select("part", "at", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["at"].cast("string"), x["h"])), ","), 256).alias("h"))
        width = -(-width // FAN)
        if width <= 1:
            break
    roots = {r["part"]: r["h"] for r in nodes.select("part", "h").collect()}
    out, start = [], 0
    for r in rows:
        out.append((r["part"], start, r["n_docs"], r["n_tokens"], roots[r["part"]]))
        start += r["n_tokens"]
    return out


def _totals(parts: list[tuple]) -> dict:
    return {"n_docs": sum(p[2] for p in parts), "n_tokens": sum(p[3] for p in parts), "root": merkle([hashlib.sha256(repr(p).encode()).digest() for p in parts]).hex()}


# ---------------------------------------------------------------- reading


def _recipes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes with their ``start``, checked against parts and manifest, and the number of buckets for their chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = _parts(recipes)
    stored = [tuple(r) for r in spark.read.parquet(f"{path}/parts").select("part", "start", "n_docs", "n_tokens", "root").orderBy("part").collect()]
    manifest = spark.read.json(f"{path}/manifest").first()
    if parts != stored:
        raise ValueError("the recipes do not match the roots and counts of the parts")
    if any(manifest[k] != v for k, v in _totals(parts).items()):
        raise ValueError("the parts do not match the manifest")
    starts = spark.createDataFrame([p[:2] for p in parts], "part int, __at long")  # a row a part
    placed = recipes.join(F.broadcast(starts), "part").withColumn("start", F.col("__at") + F.col("local_start")).drop("__at")
    return placed, _n_buckets(2 * manifest["n_tokens"])


#: Bytes of a digest by which chunks are asked for.
KEY = 16


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes recipes on whose digests give their root."""
    for b in batches:
        for key, digests, root in zip(b.column("doc_id").to_pylist(), b.column("digests").to_pylist(), b.column("root").to_pylist()):
            if merkle(digests) != root:
                raise ValueError(f"the recipe of document {key} does not match its root")
        yield b


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids, put together again: (doc_id, ids binary of the chunks' bytes, n_tokens)."""
    recipes, _ = _recipes(spark, path)
    columns = "doc_id long, part int, row long, n_tokens long, digests array<binary>, root binary"
    recipes = recipes.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(_rooted, columns).drop("root")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data")
    whole = F.sha2("data", 256) == F.lower(F.hex("digest"))
    found = F.when(whole, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("chunk "), F.lower(F.hex("digest")), F.lit(" is missing or does not match its address"))))
    return (
        recipes.select("doc_id", "part", "row", "n_tokens", F.posexplode("digests").alias("seq", "digest")).join(chunks, "digest", "left").withColumn("data", found)
        .groupBy("doc_id", "part", "row", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("c"))
        .select("doc_id", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("ids"), "n_tokens")
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests, lengths and CRCs of chunks whose bytes match their address."""
    for b in small(batches, 16_384):
        digests, sizes, data = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2)
        at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        payload = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]] if len(data) else np.zeros(0, np.uint8)
        width = len(payload) // max(1, int(sizes.sum()))
        right = (np.diff(at) == sizes * width) if width in (2, 4) else np.zeros(len(data), bool)
        wide = memoryview((payload.view("<u2").astype("<u4") if width == 2 and right.all() else payload).tobytes())
        raw, crcs = memoryview(payload.tobytes()), np.empty(len(data), np.int64)
        ends, last = (at[1:] - at[0]).tolist(), 0
        for i, (d, e) in enumerate(zip(digests, ends)):
            if not right[i] or hashlib.sha256(raw[last:e]).digest() != d:
                raise ValueError(f"chunk {d.hex()} does not match its address")
            crcs[i] = zlib.crc32(wide[4 * last // width : 4 * e // width])
            last = e
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs)], names=["digest", "n", "crc"])


def _described(n_buckets: int):
    """What is known of checked chunks, as one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _checked(batches):
            digests, sizes, crcs = b.column(0).to_pylist(), b.column(1).to_numpy().astype("<u4"), b.column(2).to_numpy().astype("<u4")
            groups = list(_bucketed(digests, n_buckets))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in groups], pa.int64()), pa.array([b"".join(digests[i][:KEY] for i in at.tolist()) for _, at in groups], pa.binary()),
                    pa.array([sizes[at].tobytes() for _, at in groups], pa.binary()), pa.array([crcs[at].tobytes() for _, at in groups], pa.binary()),
                ],
                names=["bucket", "d", "n", "crc"],
            )

    return run


#: Documents whose digests are asked for together.
BLOCK = 2048


def _wanted(n_buckets: int):
    """By block of documents and bucket, the digests that their recipes name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, block = b.column("part").to_numpy(), b.column("block").to_numpy()
            edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])))
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows]):
                names = list({d[:KEY] for row in b.column("digests").slice(lo, hi - lo).to_pylist() for d in row})
                groups = list(_bucketed(names, n_buckets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(groups), part[lo], np.int32)), pa.array(np.full(len(groups), block[lo], np.int64)), pa.array([g for g, _ in groups], pa.int64()),
                        pa.array([b"".join(names[i] for i in at.tolist()) for _, at in groups], pa.binary()),
                    ],
                    names=["part", "block", "bucket", "d"],
                )

    return run


def _places(keys: bytes, wanted: bytes) -> np.ndarray:
    """Where each of ``wanted`` is among ``keys``; both are keys of ``KEY`` bytes, joined."""
    have, want = (np.frombuffer(x, "<u8").reshape(-1, 2) for x in (keys, wanted))
    order = np.lexsort((have[:, 1], have[:, 0]))
    at = np.searchsorted(have[order, 0], want[:, 0])
    at = np.minimum(at, max(0, len(order) - 1))
    wrong = np.ones(len(want), bool) if not len(order) else (have[order[at]] != want).any(axis=1)
    if wrong.any():  # keys that share their first half, or missing ones
        known = {keys[i : i + KEY]: i // KEY for i in range(0, len(keys), KEY)}
        out = np.zeros(len(want), np.int64) if not len(order) else order[at]
        for i in np.flatnonzero(wrong).tolist():
            key = wanted[KEY * i : KEY * i + KEY]
            if key not in known:
                raise ValueError(f"chunk {key.hex()} is missing")
            out[i] = known[key]
        return out
    return order[at]


def _answered(asked: pa.Table, there: pa.Table) -> pa.Table:
    """Lengths and CRCs of the digests that blocks ask for, from the chunks of their bucket."""
    have, sizes, crcs = (b"".join(there[c].to_pylist()) for c in ("d", "n", "crc"))
    sizes, crcs, lists = np.frombuffer(sizes, "<u4"), np.frombuffer(crcs, "<u4"), asked["d"].to_pylist()
    at = _places(have, b"".join(lists))
    ends = np.cumsum([len(d) // KEY for d in lists]).tolist()
    sizes, crcs = sizes[at], crcs[at]
    ns, cs = ([x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)] for x in (sizes, crcs))
    return pa.table({"part": asked["part"], "block": asked["block"], "d": asked["d"], "n": pa.array(ns, pa.binary()), "crc": pa.array(cs, pa.binary())})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes that give their root, with the keys of their chunks joined."""
    for b in _rooted(batches):
        keys = pa.array([b"".join(d[:KEY] for d in row) for row in b.column("digests").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], keys], names=[*b.schema.names[:-2], "keys"])


def _assembled(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of one block with the number and CRC of their ids."""
    have, sizes, crcs = (b"".join(found[c].to_pylist()) for c in ("d", "n", "crc"))
    keys, n_tokens = docs["keys"].to_pylist(), docs["n_tokens"].to_numpy()
    at = _places(have, b"".join(keys))
    sizes, crcs = np.frombuffer(sizes, "<u4")[at].astype(np.int64), np.frombuffer(crcs, "<u4")[at]
    bounds = np.cumsum([0, *(len(k) // KEY for k in keys)])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if (upto[bounds[1:]] - upto[bounds[:-1]] != n_tokens).any():
        raise ValueError("a recipe's chunks do not have the document's number of ids")
    crc = join_crcs(crcs, sizes, bounds)
    return pa.table({"doc_id": docs["doc_id"], "start": docs["start"], "n_tokens": docs["n_tokens"], "ids_crc32": pa.array(crc.astype(np.int64))})


def audit(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; raises where they disagree."""
    recipes, n_buckets = _recipes(spark, path)
    recipes = recipes.select("doc_id", "part", F.floor(F.col("row") / BLOCK).alias("block"), "start", "n_tokens", "digests", "root")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "n", "data").mapInArrow(_described(n_buckets), "bucket long, d binary, n binary, crc binary")
    asked = recipes.select("part", "block", "digests").mapInArrow(_wanted(n_buckets), "part int, block long, bucket long, d binary")
    answers = asked.groupBy("bucket").cogroup(chunks.groupBy("bucket")).applyInArrow(_answered, "part int, block long, d binary, n binary, crc binary")
    keyed = recipes.mapInArrow(_keyed, "doc_id long, part int, block long, start long, n_tokens long, keys binary")
    return (
        keyed.groupBy("part", "block").cogroup(answers.groupBy("part", "block"))
        .applyInArrow(_assembled, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return audit(spark, path)
