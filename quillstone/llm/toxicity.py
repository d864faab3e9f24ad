"""Toxicity by class-conditional Kneser-Ney models (operator 8).

For each class c, a word w follows a word v with

    p_c(w | v)       = (n_c(v w) - D)+ / n_c(v)  +  l_c(v) * p_c(w)          for the pairs v w of the model
    p_c(w)           = p_c(stem) * p_c(rest | stem)                          w is its first ``STEM`` bytes, lower-cased, and its rest
    p_c(stem)        = (n_c(stem) - D)+ / n_c  +  D * types_c / n_c * q(stem)
    p_c(rest | stem) = (n_c(w) - D)+ / n_c(stem)  +  D * types_c(stem) / n_c(stem) * q(rest)

where l_c(v) is what the discounted pairs of v leave, and the backoff distributions q are continuation counts that both
classes share: q(stem) by the number of distinct words that a stem begins, q(rest) by the number of distinct stems that
a rest follows. The model's pairs are those that toxic texts have ``PAIRS`` times or more, counted in both classes; other
pairs are scored through l and p_c(w). A word that neither class has seen differs between the classes only by its stem,
and so does one that was seen once (it still counts in all sums).

A text's toxic and ordinary log-likelihoods are compared after dividing by length: over the whole text, in
the window of ``WINDOW`` words where the ratio is highest, and over its two most telling words. A logistic
curve turns the three ratios into a score. It is fitted on a sample of each class that the counts do not use:
by a hash of doc_id a quarter of the class, at most about ``SAMPLE / 2`` documents (the documented bound), each
weighted by the documents of its class that it stands for. Counts cover every other labelled row. A class of
fewer than four documents is counted whole, and the curve uses these.

Words, stems, rests and pairs are told apart by hashes of 64 bits, so the model grows with the labelled text.

Scale: labels are broadcast when their counted rows are at most ``broadcast_labels``, else they meet the
documents in a shuffle join. Counts and ratios are a distributed table. Its most frequent rows, at most
``HELD``, are sent to every task; if these are all, scoring is one pass. The others are joined: documents are
dealt to blocks of about ``BLOCK_BYTES``, blocks ask for the words, stems and pairs that are not held, and the ratios
that are found meet the block's texts. A filter of ``BITS`` bits (2 MB), three for each pair, tells nearly all pairs of a text that are not the model's.

Defined results: a null or empty text has ratios of 0; a very long one is scored whole. Labels that are null are ignored,
of repeated labels the highest counts. Without examples of both classes every score is 0. Repeated rows each get their
row, a null doc_id too (it has no label). Other columns pass, but for one of the score's name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BITS, LETTERS, Words, as_signed, bit_filter, blocks, drop_staged, mix, small, staged

STEM = 4
WINDOW = 32
DISCOUNT = 0.75
#: How often toxic texts must have a pair of words that has counts of its own.
PAIRS = 2
#: Where in a pair's key the numbers of its bits in the filter begin: a pair that is not the model's must meet set bits at each.
PROBES = (0, 24, 40)
#: Rows of the table of ratios that every task may get, and bytes of a block of documents if there are more.
HELD, BLOCK_BYTES = 1 << 21, 16 << 20
#: Distinct words or pairs of a task that are added up before they are sent on.
ADDED = 1 << 18
#: Tells a stem's key from that of an equal word.
STEM_KEY = 0x5DEECE66D1234567
SAMPLE = 20_000
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _units(parts: list[bytes]):
    """Hashes of the words, stems and rests of several texts, and the bounds of each text."""
    w = Words(parts, LETTERS)
    cut = np.minimum(w.starts + STEM, w.ends)
    stem, rest = as_signed(w.hashes(w.starts, cut)), as_signed(w.hashes(cut, w.ends))
    return as_signed(w.hashes()), stem, rest, w.bounds


def _follows(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words that follow another of their text, and the keys of these pairs."""
    first = np.zeros(len(word) + 1, bool)
    first[bounds[:-1]] = True
    at = np.flatnonzero(~first[:-1])
    with np.errstate(over="ignore"):
        return at, as_signed(mix(word[at - 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word[at].view(np.uint64)))


def _lowered(column: pa.Array) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


class _Sums:
    """Adds up rows (key, a, b, ordinary, toxic) of one kind and gives them out before they are too many."""

    def __init__(self, kind: int):
        self.kind, self.held, self.n = kind, [], 0

    def _added(self) -> list[np.ndarray]:
        key, a, b, *counts = (np.concatenate(c) for c in zip(*self.held))
        key, first, of = np.unique(key, return_index=True, return_inverse=True)
        return [key, a[first], b[first], *(np.bincount(of, weights=n, minlength=len(key)).astype(np.int64) for n in counts)]

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.held = [self._added()] if len(self.held) > 1 and sum(len(h[0]) for h in self.held) > 2 * ADDED else self.held
            if len(self.held) == 1 and len(self.held[0][0]) > ADDED:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns, self.held = self._added(), []
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), self.kind, np.int32)), *map(pa.array, columns)], names=[c.split()[0] for c in _COUNTS.split(", ")])


_COUNTS = "kind int, key long, a long, b long, ordinary long, toxic long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): words with stem and rest (kind 0) by class, and pairs of words in toxic texts (kind 1)."""
    words, pairs = _Sums(0), _Sums(1)
    for batch in small(batches):
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        for at, parts in blocks(_lowered(batch.column(0))):
            word, stem, rest, bounds = _units(parts)
            of = np.repeat(toxic[at : at + len(parts)], np.diff(bounds))
            yield from words.add(word, stem, rest, of == 0, of == 1)
            where, key = _follows(word, bounds)
            bad = of[where] == 1
            where, key = where[bad], key[bad]
            yield from pairs.add(key, word[where - 1], word[where], np.zeros(len(key), bool), np.ones(len(key), bool))
    yield from words.rest()
    yield from pairs.rest()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, m0): how often ordinary documents, from (text), have each pair, added up over ``4 * ADDED`` pairs at a time."""
    held: list[np.ndarray] = []

    def added() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "m0"])

    for batch in small(batches):
        for _, parts in blocks(_lowered(batch.column(0))):
            word, _, _, bounds = _units(parts)
            held.append(_follows(word, bounds)[1])
            if sum(map(len, held)) >= 4 * ADDED:
                yield added()
    if held:
        yield added()


def _may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    some = np.arange(len(keys))
    for shift in PROBES:
        at = (keys[some].view(np.uint64) >> np.uint64(shift)).view(np.int64) & (BITS - 1)
        some = some[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    out = np.zeros(len(keys), bool)
    out[some] = True
    return out


def _tables(rows: DataFrame) -> tuple[DataFrame, float, np.ndarray] | None:
    """(key, ratio, context, n) of counted words, stems and pairs; the ratio of a word whose stem was not seen; the pairs' filter.

    A row's ratio belongs to the word (or pair), its context to what follows the word.
    """
    counted = rows.select("text", "toxic").mapInArrow(_count, _COUNTS).groupBy("kind", "key").agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1")
    )
    counts = staged(counted.filter((F.col("kind") == 0) | (F.col("n1") >= PAIRS)), "counts")
    words = counts.filter("kind = 0").select(F.col("key").alias("word"), F.col("a").alias("stem"), F.col("b").alias("rest"), "n0", "n1")
    d, seen = DISCOUNT, lambda c: F.sum((F.col(c) > 0).cast("long"))
    stems = words.groupBy("stem").agg(F.count("*").alias("begins"), F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), seen("n0").alias("t0"), seen("n1").alias("t1"))
    stems = by_stems = staged(stems, "stems")
    rests = words.groupBy("rest").agg(F.count("*").alias("follows"))  # distinct stems that a rest follows
    total = stems.agg(F.sum("begins").alias("words"), F.count("*").alias("stems"), F.sum("s0").alias("n0"), F.sum("s1").alias("n1"), seen("s0").alias("k0"), seen("s1").alias("k1")).first()
    if not (total["n0"] and total["n1"]):
        return None
    n_rests = words.select("rest").distinct().count()
    q_stem = (F.col("begins") + 1 / (total["stems"] + 1)) / (total["words"] + 1)
    q_rest = (F.col("follows") + 1 / (n_rests + 1)) / (total["words"] + 1)
    for c in "01":
        of, n = F.col(f"s{c}"), total[f"n{c}"]
        stems = stems.withColumn(f"p{c}", F.greatest(of - d, F.lit(0.0)) / n + d * total[f"k{c}"] / n * q_stem)
        stems = stems.withColumn(f"back{c}", F.when(of > 0, d * F.col(f"t{c}") / of).otherwise(1.0))
    unseen = F.log(F.col("p1") * F.col("back1")) - F.log(F.col("p0") * F.col("back0"))
    p = {c: F.col(f"p{c}") * (F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.greatest(F.col(f"s{c}"), F.lit(1)) + F.col(f"back{c}") * q_rest) for c in "01"}
    often = words.filter(F.col("n0") + F.col("n1") > 1)
    known = staged(often.join(stems, "stem").join(rests, "rest").select("word", "n0", "n1", p["0"].alias("w0"), p["1"].alias("w1")), "known")

    pairs = counts.filter("kind = 1").select(F.col("key").alias("pair"), F.col("a").alias("v"), F.col("b").alias("w"), F.col("n1").alias("m1"))
    bits = bit_filter(pairs.select(F.explode(F.array(*[F.shiftrightunsigned("pair", n) for n in PROBES])).alias("place")), "place")
    # All pairs of ordinary texts are counted: those of the model alone would be repeated by each task, in growing numbers.
    ordinary = rows.filter("toxic = 0").select("text").mapInArrow(_count_pairs, "pair long, m0 long").groupBy("pair").agg(F.sum("m0").alias("m0"))
    pairs = pairs.join(ordinary, "pair", "left").withColumn("m0", F.coalesce("m0", F.lit(0)))
    of_v = known.select(F.col("word").alias("v"), F.col("n0").alias("v0"), F.col("n1").alias("v1"))
    share = lambda c: F.when(F.col(f"v{c}") > 0, F.greatest(F.col(f"m{c}") - d, F.lit(0.0)) / F.col(f"v{c}")).otherwise(0.0)
    pairs = staged(pairs.join(of_v, "v").select("pair", "v", "w", (F.col("m0") + F.col("m1")).alias("n"), share("0").alias("f0"), share("1").alias("f1")), "pairs")
    left = pairs.groupBy("v").agg((1 - F.sum("f0")).alias("l0"), (1 - F.sum("f1")).alias("l1"))
    context = F.log("l1") - F.log("l0")
    word_ratio = F.log("w1") - F.log("w0")
    by_word = known.join(left, known["word"] == left["v"], "left").select(
        F.col("word").alias("key"), word_ratio.cast("float").alias("ratio"), F.coalesce(context, F.lit(0.0)).cast("float").alias("context"), (F.col("n0") + F.col("n1")).alias("n")
    )
    none = F.lit(0.0).cast("float").alias("context")
    by_stem = stems.select(F.col("stem").bitwiseXOR(F.lit(STEM_KEY)).alias("key"), unseen.cast("float").alias("ratio"), none, (F.col("s0") + F.col("s1")).alias("n"))
    whole = lambda c: F.log(F.col(f"f{c}") + F.col(f"l{c}") * F.col(f"w{c}"))
    own = whole("1") - whole("0") - context - word_ratio  # beyond what context and word say anyway
    by_pair = pairs.join(left, "v").join(known.select(F.col("word").alias("w"), "w0", "w1"), "w").select(F.col("pair").alias("key"), own.cast("float").alias("ratio"), none, "n")
    other = float(np.log(total["k1"] / total["n1"]) - np.log(total["k0"] / total["n0"]))
    table = staged(by_word.unionAll(by_stem).unionAll(by_pair), "ratios")
    drop_staged(counts, by_stems, known, pairs)
    return table, other, bits


class Ratios:
    """Log-likelihood ratios by word, by stem for words that were not seen (often), by pair, and one for all other words."""

    def __init__(self, table: pa.Table, other: float, bits: np.ndarray):
        keys = table["key"].to_numpy()
        order = np.argsort(keys)
        self.keys, self.other, self.bits = keys[order], other, bits
        self.values = np.stack([table["ratio"].to_numpy()[order], table["context"].to_numpy()[order]])
        self.curve, self.more = np.zeros(4), None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' ratios and contexts, as two rows; not a number where there is none."""
        x = np.full((2, len(keys)), np.nan)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            x[:, hit] = self.values[:, at[hit]]
        if self.more is not None:
            new = np.flatnonzero(np.isnan(x[0]))
            x[:, new] = self.more.find(keys[new])
        return x

    def pairs(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the pairs that the filter lets through."""
        at, key = _follows(word, bounds)
        some = _may_be(self.bits, key)
        return at[some], key[some]

    def each(self, word: np.ndarray, stem: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The ratio of every word after the one before it."""
        x, context = self.find(word)
        new = np.flatnonzero(np.isnan(x))
        x[new] = self.find(stem[new] ^ STEM_KEY)[0]
        x[np.isnan(x)] = self.other
        context = np.nan_to_num(context)
        context[bounds[1:][np.diff(bounds) > 0] - 1] = 0  # nothing follows a text's last word
        x[1:] += context[:-1]
        at, key = self.pairs(word, bounds)
        x[at] += np.nan_to_num(self.find(key)[0])
        return x

    def ratios(self, parts: list[bytes]) -> np.ndarray:
        """For each text: the ratio a word over the text, in its highest window, and of its two highest words."""
        word, stem, _, bounds = _units(parts)
        x = self.each(word, stem, bounds)
        out = np.zeros((len(parts), 3))
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        first, n = bounds[:-1][full], size[full]
        sums = np.concatenate([[0.0], np.cumsum(x)])
        out[full, 0] = (sums[first + n] - sums[first]) / n
        last = np.repeat(first + n, n)
        at = np.arange(len(x))
        wide = np.repeat(np.minimum(n, WINDOW), n)
        windows = (sums[np.minimum(at + WINDOW, last)] - sums[at]) / wide
        out[full, 1] = np.maximum.reduceat(windows, first)
        top = np.maximum.reduceat(x, first)
        where = np.flatnonzero(x == np.repeat(top, n))
        x[where[np.searchsorted(where, first)]] = -np.inf
        second = np.maximum.reduceat(x, first)
        out[full, 2] = np.where(n > 1, (top + np.where(n > 1, second, 0)) / 2, top / 2)
        return out

    def fit_curve(self, ratios: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> None:
        """Logistic regression by Newton's steps, halved where they overshoot, with a small ridge."""
        x = np.column_stack([np.ones(len(ratios)), ratios])
        w = np.zeros(4)
        loss = lambda w: (weights * np.logaddexp(0, (1 - 2 * toxic) * (x @ w))).sum() + 0.05 * w @ w
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
            step = np.linalg.solve(h, x.T @ (weights * (toxic - p)) - 0.1 * w)
            for _ in range(30):
                if loss(w + step) <= loss(w):
                    break
                step = step / 2
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w

    def score(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + ratios @ self.curve[1:], -500, 500)))


class Model:
    """The most frequent rows of the table of ratios, and, if it has more than ``HELD``, the rest of it."""

    def __init__(self, table: DataFrame, other: float, bits: np.ndarray):
        self.rest = None
        if table.count() > HELD:
            sizes = table.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).toArrow()
            n, rows = sizes["n"].to_numpy(), np.cumsum(sizes["count"].to_numpy())
            least = int(n[np.searchsorted(rows, HELD, "right")]) + 1  # the first count whose rows do not fit
            table, self.rest = table.filter(F.col("n") >= least), table.filter(F.col("n") < least)
            if least > 1 << 20:
                table, self.rest = table.limit(0), table.unionAll(self.rest)
        self.ratios = Ratios(table.select("key", "ratio", "context").toArrow(), other, bits)


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from."""
    known = labels.dropna(subset=["doc_id", "toxic"]).filter(fold(F.col("doc_id")) != 0)
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")


def _bounds(found: DataFrame) -> tuple[dict[int, int | None], dict[int, int]]:
    """For each class of ``found`` (doc_id, toxic): the hash up to which documents are in the sample, and its size."""
    sizes = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half, bounds = SAMPLE // 2, {}
    for c, n in sizes.items():
        if n > 4 * half:  # so many that the share of all hashes is near enough
            bounds[c] = int(half / n * 2**64) - 2**63
        elif n >= 4:  # at most 2 * SAMPLE hashes
            least = found.filter(F.col("toxic") == c).select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(n // 4)
            bounds[c] = least.agg(F.max("h")).first()[0]
        else:
            bounds[c] = None
    return bounds, sizes


def fit(docs: DataFrame, labels: DataFrame, broadcast_labels: int = 2_000_000) -> Model | None:
    """A model from labelled documents; None without examples of both classes."""
    known = _known(labels)
    few = labels.select("doc_id").limit(broadcast_labels + 1).count() <= broadcast_labels
    found = staged(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    bounds, sizes = _bounds(found)
    rows = docs.select("doc_id", "text").join(F.broadcast(found) if few else found, "doc_id")
    inside = F.lit(False)
    for c, bound in bounds.items():
        if bound is not None:
            inside |= (F.col("toxic") == c) & (F.xxhash64("doc_id") <= F.lit(bound))
    tables = _tables(rows.filter(~inside))
    if tables is None:
        return None
    model = Model(*tables)
    whole = F.col("toxic").isin([c for c, bound in bounds.items() if bound is None])
    got = (
        _measured(rows.filter(inside | whole), model, lambda m, r: r, "a double, b double, c double")
        .groupBy("doc_id", "toxic").agg(F.min(F.struct("a", "b", "c")).alias("x")).select("toxic", "x.*").toPandas()  # a row a document
    )
    toxic = got["toxic"].to_numpy().astype(float)
    stands = np.array([sizes[c] / n for c, n in sorted(got["toxic"].value_counts().items())])
    weights = (stands / stands.min())[toxic.astype(int)]
    model.ratios.fit_curve(got[["a", "b", "c"]].to_numpy(), toxic, weights)
    return model


def _asked(shared):
    """The distinct keys that are not held of words, stems and pairs, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ratios = shared.value
        for batch in small(batches):
            block = batch.column(0).to_numpy()
            for at, parts in blocks(_lowered(batch.column(1))):
                word, stem, _, bounds = _units(parts)
                of = np.repeat(block[at : at + len(parts)], np.diff(bounds))
                new = np.isnan(m.find(word)[0])
                where, pair = m.pairs(word, bounds)
                asked = [(of[new], word[new]), (of[new], stem[new] ^ STEM_KEY), (of[where], pair)]
                asked = [(o[gone], k[gone]) for o, k in asked for gone in [np.isnan(m.find(k)[0])]]
                pairs = pa.table({"__block": np.concatenate([o for o, _ in asked]), "key": np.concatenate([k for _, k in asked])})
                yield from pairs.group_by(["__block", "key"]).aggregate([]).select(["__block", "key"]).to_batches()

    return run


def _measured(rows: DataFrame, model: Model, make, schema: str, keep_text: bool = False) -> DataFrame:
    """``rows`` with the columns that ``make`` gives; ``text`` only if asked for."""
    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    names = [*(f.name for f in kept), *(c.split()[0] for c in schema.split(", "))]
    whole = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema])

    def one(m: Ratios, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [make(m, m.ratios(parts)) for _, parts in blocks(_lowered(batch.column("text")))]
        values = np.concatenate(found).reshape(batch.num_rows, -1) if found else np.zeros((0, len(names) - len(kept)))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=names)

    shared = rows.sparkSession.sparkContext.broadcast(model.ratios)
    if model.rest is None:
        return rows.mapInArrow(lambda batches: (one(shared.value, b) for b in small(batches)), whole)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        m = copy(shared.value)
        m.more = Ratios(right, m.other, m.bits)
        return pa.Table.from_batches([one(m, b) for b in left.to_batches()])

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // BLOCK_BYTES + 1)))
    found = dealt.select("__block", "text").mapInArrow(_asked(shared), "__block long, key long").join(model.rest.select("key", "ratio", "context"), "key").select("__block", "key", "ratio", "context")
    return dealt.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(joined, whole)


def score(docs: DataFrame, model: Model | None, out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with a score from 0 to 1; ``text`` is dropped unless asked for."""
    if model is None:
        return (docs if keep_text else docs.drop("text")).withColumn(out, F.lit(0.0))
    return _measured(docs.drop(out), model, lambda m, r: m.score(r), f"{out} double", keep_text)  # a column of that name gives way


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
