"""Relevance and latency measures over ranked results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGES = 64


def top_docs(scores: DataFrame, size: int) -> tuple[int, DataFrame]:
    """(number of documents, the best of them) of ``scores`` (doc, score): highest first, ties by doc; scores must be finite."""
    if size <= 0:
        raise ValueError("size must be positive")
    found = scores.agg(F.count("*").alias("n"), F.count_if(F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad")).first()
    if found["bad"]:
        raise ValueError("a score is not finite")
    return found["n"], scores.orderBy(F.desc("score"), "doc").limit(size)


def report(runs: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, median, most, baseline, ok, change): runs (metric, value) against limits (metric, most, baseline).

    A metric is ok if its median is at most ``most``; ``change`` is the median's change from ``baseline`` in per cent.
    """
    medians = runs.filter(F.col("value").isNotNull()).groupBy("metric").agg(F.median("value").alias("median"))
    return limits.join(medians, "metric", "left").select(
        "metric", "median", "most", "baseline", F.coalesce(F.col("median") <= F.col("most"), F.lit(False)).alias("ok"), F.round((F.col("median") / F.col("baseline") - 1) * 100, 3).alias("change")
    )


def ndcg(hits: DataFrame, judgements: DataFrame, k: int = 10, graded: bool = False) -> DataFrame:
    """(query_id, ndcg) for ``hits`` (query_id, doc_id, rank from 1) and ``judgements`` (query_id, doc_id, rel > 0)."""
    gain = (lambda c: F.pow(F.lit(2.0), c) - 1) if graded else (lambda c: F.lit(1.0))
    dcg = (
        hits.filter(F.col("rank") <= k).join(judgements, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("rel")) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = (
        judgements.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel")) / F.log2(F.col("n") + 1.0)).alias("ideal"))
    )
    return ideal.join(dcg, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def recall(hits: DataFrame, judgements: DataFrame, k: int = 10, any_hit: bool = False) -> DataFrame:
    """(query_id, recall): the share of relevant documents among the first k, or whether there is one."""
    found = hits.filter(F.col("rank") <= k).join(judgements, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    rows = judgements.groupBy("query_id").agg(F.count("*").alias("r")).join(found, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("query_id", F.when(n > 0, 1.0).otherwise(0.0).alias("recall") if any_hit else (n / F.col("r")).alias("recall"))


def nearest_rank(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """(percent, value): exact nearest-rank percentiles of a number; ranks are found by counting, not by gathering.

    Values fall into about ``RANGES`` ranges of like size, whose totals come to the driver; only within a range are values put in order.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    edges = counts.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("e")).first()["e"] or []
    own = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(value))) if edges else F.lit(0)
    counts = counts.withColumn("__range", own)
    totals = {r["__range"]: r["n"] for r in counts.groupBy("__range").agg(F.sum("__n").alias("n")).collect()}  # a row a range
    before, n = {}, 0
    for k in sorted(totals):
        before[k], n = n, n + totals[k]
    ranks = {p: max(1, math.ceil(p / 100 * n)) for p in percents}
    needed = sorted({k for k in totals for r in ranks.values() if before[k] < r <= before[k] + totals[k]})
    if not needed:
        return df.sparkSession.createDataFrame([], f"percent double, {value} {dict(df.dtypes)[value]}")
    counts = counts.filter(F.col("__range").isin(needed))
    offset = F.element_at(F.create_map(*[x for k in needed for x in (F.lit(k), F.lit(before[k]))]), F.col("__range"))
    upto = counts.withColumn("__upto", offset + F.sum("__n").over(Window.partitionBy("__range").orderBy(value)))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.lit(r).alias("rank")) for p, r in ranks.items()])
    hit = upto.select(value, "__upto", (F.col("__upto") - F.col("__n")).alias("__from"), F.explode(wanted).alias("p"))
    return hit.filter((F.col("p.rank") > F.col("__from")) & (F.col("p.rank") <= F.col("__upto"))).select("p.percent", value)


def overlap(a: Column, b: Column) -> Column:
    """How many ids two result lists share."""
    return F.size(F.array_intersect(a, b))


def suggest(docs: DataFrame, text: str, columns: list[str], order: str, size: int = 8) -> DataFrame:
    """Rows that contain the text, folded and lower-cased, in any of the columns; nothing for fewer than two characters."""
    from quillstone.functions.analysis import fold, fold_letters

    wanted = (fold(text) or "").lower().strip()
    if len(wanted) < 2:
        return docs.limit(0)
    return docs.filter(F.contains(fold_letters(F.lower(F.concat_ws(" ", *columns))), F.lit(wanted))).orderBy(order).limit(min(size, 25))


def differences(want, got, ignored: list[str] = (), tolerance: float = 0.0, path: str = "") -> list[str]:
    """Paths at which two JSON values differ; ``*`` in an ignored path stands for any key or place."""
    import fnmatch

    if any(fnmatch.fnmatchcase(path, p) for p in ignored):
        return []
    if isinstance(want, dict) and isinstance(got, dict):
        return [d for k in sorted({*want, *got}) for d in (differences(want[k], got[k], ignored, tolerance, f"{path}.{k}".lstrip(".")) if k in want and k in got else [] if any(fnmatch.fnmatchcase(f"{path}.{k}".lstrip("."), p) for p in ignored) else [f"{path}.{k}".lstrip(".")])]
    if isinstance(want, list) and isinstance(got, list):
        if len(want) != len(got):
            return [path]
        return [d for i, (a, b) in enumerate(zip(want, got)) for d in differences(a, b, ignored, tolerance, f"{path}.{i}".lstrip("."))]
    if "score" in path.lower() and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (want, got)):
        return [] if abs(want - got) <= tolerance else [path]
    return [] if want == got and type(want) is type(got) else [path]
