"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 7).

Texts are normalised: lower-cased, words (letters, digits and all beyond ASCII) joined by single spaces.
A document is contaminated by an item when some stretch of it is within ``floor(ERROR * item length)``
edits of the whole item; lengths and edits count UTF-8 bytes of normalised text.

1. Windows. An item is cut into pieces of 8 bytes (6 or 5 if it is short). An edit destroys one piece at
   most, so at least ``pieces - edits`` of them are in any match, on diagonals that differ by at most the
   number of edits. Every place of a document where so many pieces of an item agree gives one stretch that
   holds all its matches, and item-sized windows in it that begin where the pieces' diagonals say that the item does:
   the lowest (right if bytes were put in), the highest (if bytes were lost) and those between. No stretch is
   dropped or capped. Words play no part in it.
2. CGK: a random walk copies a string's bytes to a longer output, moving on at random bits that depend on step and
   byte, followed for 1.8 times its length. Strings at a small edit distance come out at a small Hamming
   distance. Item and window take the same walks.
3. Bit sampling: a stretch is a candidate when one of its windows agrees with the item in all ``BITS`` sampled places
   of one of ``TABLES`` tables. Tables are so many that the recall of this step, measured over substitutions, insertions,
   deletions, lost spaces and mixtures of 5, 8 and 10 % (the threshold), is 0.96 or more for each; an unchanged copy always agrees.
4. Verification: the least edit distance of the item to any part of a candidate stretch, exactly.

Scale: documents are read once, without a shuffle. The items are collected in groups of at most
``GROUP_BYTES``, which every task gets; a larger benchmark takes further passes.

Defined results: null and empty texts, and items without words, match nothing; so do null items. Very long texts are searched
whole, in blocks of rows (a block has at most 2**29 bytes). Repeated documents and items each give their rows, and
a null doc_id or item_id is one like others. Other columns are not read. Rows: doc_id, item_id, edits (the fewest of any
candidate). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LETTERS, Words, blocks, small

ERROR = 0.1
BITS, TABLES, WALKS = 4, 300, 6
#: Which of a stretch's diagonals, in order, windows begin at: shares of the pieces that agree.
STARTS = (0.0, 0.25, 0.5, 0.75, 1.0)
GROUP_BYTES = 32 << 20
#: Bits for a place in a block of texts.
DIAGONAL = 30
SEED = 20240607


def normalised(words: Words) -> tuple[bytes, np.ndarray]:
    """All words of a block joined by single spaces, and where each starts there."""
    size = words.ends - words.starts
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    letters = words.data[LETTERS[words.data]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out.tobytes(), at


def least_edits(item: bytes, text: bytes, most: int) -> int:
    """The fewest edits from ``item`` to any stretch of ``text`` (bit-parallel, whole item in one integer); most + 1 if more."""
    m = len(item)
    if not m:
        return 0
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & ones
        plus = (down | ~(d0 | up)) & ones
        minus = d0 & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & ones  # the first row is free: a stretch may start anywhere
        minus = minus << 1 & ones
        up = (minus | ~(d0 | plus)) & ones
        down = plus & d0
        best = min(best, score)
    return min(best, most + 1)


def piece_size(length: int, most: int) -> int:
    """Bytes of an item's pieces: the longest of which more than ``most`` fit, if possible by two."""
    for least in (2, 1):
        for size in (8, 6, 5):
            if length // size - most >= least:
                return size
    return length  # shorter than five bytes


class Items:
    """Pieces of one group of items, their texts and sampled walks."""

    def __init__(self, rows: list[tuple[int, str]], error: float = ERROR):
        self.keys, self.texts = [], []
        for key, text in rows:
            w = Words([(text or "").lower().encode("utf-8", "surrogatepass")], LETTERS)
            if len(w.starts):
                self.keys.append(key)
                self.texts.append(normalised(w)[0][:-1])
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(len(t) * error) for t in self.texts], np.int64)
        size = np.array([piece_size(n, k) for n, k in zip(self.length.tolist(), self.most.tolist())], np.int64)
        self.need = self.length // size - self.most
        #: For each size: the pieces' bytes as sorted numbers, their items and places, and a filter.
        self.pieces = []
        for n in sorted(set(size.tolist())):
            rows = sorted((int.from_bytes(self.texts[i][at : at + n], "little"), int(i), at) for i in np.flatnonzero(size == n) for at in range(0, len(self.texts[i]) - n + 1, n))
            value, item, at = np.array([r[0] for r in rows], np.uint64), *(np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            some = np.zeros(1 << 20, bool)
            some[_slot(value)] = True
            self.pieces.append((n, value, item, at, some))
        self._samples = None

    def samples(self) -> np.ndarray:
        """The items' own sampled bytes, made once in each worker."""
        if self._samples is None:
            self._samples = sampled(self.texts, self.length)
        return self._samples

    def windows(self, joined: bytes, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, item, starts, low, high): stretches from low to high hold every match; text ``i`` starts at ``first[i]``.

        ``starts`` has ``len(STARTS)`` columns.
        """
        n_items, middle = len(self.texts), 1 << (DIAGONAL - 1)
        every = np.ndarray(len(joined), "<u8", joined + bytes(8), 0, (1,)).astype(np.uint64)  # the eight bytes from each place on
        keys = []
        for n, value, item, at, some in self.pieces:
            here = every & np.uint64((1 << 8 * n) - 1)
            hit = np.flatnonzero(some[_slot(here)])
            lo, hi = np.searchsorted(value, here[hit], "left"), np.searchsorted(value, here[hit], "right")
            hit, lo, count = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            place = np.repeat(hit, count)
            post = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text = np.searchsorted(first, place, "right") - 1
            # One sortable number: text, item and, in the lowest bits, diagonal.
            keys.append(((text * n_items + item[post]) << DIAGONAL) + (place - at[post]) + middle)
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        item = (key >> DIAGONAL) % max(1, n_items)
        # Number of hits of the same text and item within the edits after each.
        agree = np.searchsorted(key, np.minimum(key + self.most[item], key | ((1 << DIAGONAL) - 1)), "right") - np.arange(len(key))
        good = np.flatnonzero(agree >= self.need[item])
        # Runs that start in one cell of a diagonal's width have one stretch; the one with most agreement aligns the windows.
        pair, width = key[good] >> DIAGONAL, self.most[item[good]] + 1
        cell = (key[good] & ((1 << DIAGONAL) - 1)) // width
        order = np.lexsort((-agree[good], cell, pair))
        good, cell, pair, width = good[order], cell[order], pair[order], width[order]
        new = np.ones(len(good), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (cell[1:] != cell[:-1])
        good, cell, pair, width = good[new], cell[new], pair[new], width[new]
        item, most = pair % max(1, n_items), width - 1
        which = good[:, None] + np.rint((agree[good] - 1)[:, None] * np.array(STARTS)).astype(np.int64)
        starts = (key[which] & ((1 << DIAGONAL) - 1)) - middle
        low = cell * width - middle
        return pair // max(1, n_items), item, starts, low - most, low + 3 * most + self.length[item]


def _slot(values: np.ndarray) -> np.ndarray:
    """A place in a filter of 2**20 bits."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


#: Walks are followed for this many steps a byte of the item; at a half step on average, a walk is then
#: still inside the string, and padding is not sampled.
STEPS = 1.8


def embed(strings: list[bytes], lengths: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK embedding of byte strings, cut or padded to ``lengths``, along one walk (0: past the end)."""
    n, most = len(strings), int(lengths.max(initial=0))
    padded = np.frombuffer(b"".join(x[:k].ljust(most + 1, b"\0") for x, k in zip(strings, lengths.tolist())), np.uint8)
    row, at = np.arange(n) * (most + 1), np.zeros(n, np.int64)
    out = np.empty((int(STEPS * most) + 1, n), np.uint8)
    for j in range(len(out)):
        c = padded[row + at]
        out[j] = c
        at = np.minimum(at + bits[j][c], lengths)
    return out


def sampled(strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The bytes at all sampled places: (tables, bits, strings). Walks and places are the same for every string."""
    rng = np.random.default_rng(SEED)
    steps = int(STEPS * lengths.max(initial=0)) + 1
    out = np.empty((TABLES, BITS, len(strings)), np.uint8)
    for w in range(WALKS):
        bits = np.random.default_rng([SEED, w]).integers(0, 2, (steps, 256), dtype=np.uint8)
        got = embed(strings, lengths, bits)
        for t in range(w, TABLES, WALKS):
            for b, u in enumerate(rng.random(BITS)):
                out[t, b] = got[(u * STEPS * lengths).astype(np.int64), np.arange(len(strings))]
    return out


def similar(items: Items, item: np.ndarray, windows: list[bytes]) -> np.ndarray:
    """Which windows agree with their item in all sampled places of some table."""
    a = items.samples()[:, :, item]
    b = sampled(windows, items.length[item])
    return ((a == b) & (b > 0)).all(axis=1).any(axis=0)


def _matches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in small(batches):
            keys = batch.column(0)
            found: dict[tuple[int, int], int] = {}
            row, item, window, around = [], [], [], []

            def settle() -> None:
                if item:
                    n = len(STARTS)
                    distinct = {w: k for k, w in enumerate(dict.fromkeys((item[k // n], w) for k, w in enumerate(window)))}
                    near = similar(items, np.array([i for i, _ in distinct]), [w for _, w in distinct])
                    near = np.array([near[distinct[item[k // n], w]] for k, w in enumerate(window)]).reshape(-1, n).any(axis=1)
                    for k in np.flatnonzero(near).tolist():
                        i, most = item[k], int(items.most[item[k]])
                        if found.get((row[k], i)) == 0:
                            continue
                        edits = least_edits(items.texts[i], around[k], most)
                        if edits <= most:
                            found[row[k], i] = min(edits, found.get((row[k], i), edits))
                for x in (row, item, window, around):
                    x.clear()

            for first, parts in blocks([(t or "").lower() for t in batch.column(1).to_pylist()]):
                words = Words(parts, LETTERS)
                joined, at = normalised(words)
                bounds = np.append(at, len(joined))[words.bounds]
                text, which, starts, low, high = items.windows(joined, bounds[:-1])
                lo, hi = bounds[text], bounds[text + 1] - 1
                for t, i, ss, a, b in zip(text.tolist(), which.tolist(), starts.tolist(), np.maximum(low, lo).tolist(), np.minimum(high, hi).tolist()):
                    row.append(first + t)
                    item.append(i)
                    window += [joined[max(a, s) : min(b, s + int(items.length[i]))] for s in ss]
                    around.append(joined[a:b])
                if len(item) > 4_000:
                    settle()
            settle()
            names = items.keys
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array([r for r, _ in found], pa.int64())), pa.array([names[i] for _, i in found], pa.int64()), pa.array(list(found.values()), pa.int32())],
                names=["doc_id", "item_id", "edits"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """(doc_id, item_id, edits) of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    known = benchmark.select("item_id", "text").dropna(subset=["text"])
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_groups = max(1, -(-2 * int(size) // GROUP_BYTES) if size > GROUP_BYTES else 1)
    found = []
    for g in range(n_groups):
        group = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups)) == g) if n_groups > 1 else known
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in group.orderBy("item_id", "text").collect()], error))
        found.append(docs.select("doc_id", "text").mapInArrow(_matches(shared), "doc_id long, item_id long, edits int"))
    return reduce(DataFrame.unionAll, found)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
