"""URL allow/block rules by host-suffix and path-prefix expressions (operator 5).

Each URL is expanded into (host suffix, path prefix) expressions, restricted to the label counts and
prefix lengths that some rule has. Expressions meet rules in an equi-join on a short hash prefix; the
full digest then confirms the match, and the longest confirmed rule wins.

Scale: URLs are first reduced to distinct (host, path) pairs, so a host or URL with a third of the rows
is judged once. Pages get their URL's rule in a shuffle join; those of a URL with more than one in ``HOT`` rows get it
by a broadcast of fewer than ``HOT`` rows, and like those without a host take any place in the shuffle. Rules are broadcast
only when their counted number is at most ``broadcast_rules``; beyond that the join shuffles on the short hash.

Defined results: null URLs and URLs without ``://`` have an empty host and path and get the default
verdict; very long ones are judged whole. Repeated rules count once; of rules of equal length the one with the longer
host wins, then ``block``. Repeated pages each get their row. Columns beyond the named ones (host, path, rule, verdict) pass
through. An empty table gives no rows, an empty list of rules the default for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lower_ascii, staged

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


#: A URL with more than one in so many rows is looked up by broadcast.
HOT = 1000


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    rules = (
        rules.dropna(subset=["host", "path", "action"]).select("action", lower_ascii(F.col("host")).alias("host"), "path")
        .groupBy("host", "path").agg(F.max("action").alias("action"))  # of an allow and a block of one expression, the block
    )
    # The label counts and prefix lengths that occur: two short lists, bounded by the longest host name and rule path.
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    host, path = split_url(F.col(url))
    taken = pages.columns
    pages = pages.withColumns({"__host": host, "__path": path})
    if not shapes["n"]:
        best = None
    else:
        labels, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])
        urls = pages.select("__host", "__path").filter("__host <> ''").groupBy("__host", "__path").agg(F.count("*").alias("__n"))
        n_labels = F.size(F.split("__host", r"\."))
        suffixes = F.filter(F.array(*[F.when(n_labels >= k, F.substring_index("__host", ".", -k)) for k in labels]), lambda x: x.isNotNull())
        prefixes = F.filter(F.array(*[F.when(F.length("__path") >= p, F.substring("__path", 1, p)) for p in lengths]), lambda x: x.isNotNull())
        pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("s"), p.alias("p")))))
        seen = (
            urls.select("__host", "__path", "__n", F.explode(pairs).alias("e"))
            .withColumn("__full", _digest(F.col("e.s"), F.col("e.p")))
            .select("__host", "__path", "__n", "__full", _short(F.col("__full")).alias("__short"))
        )
        index = rules.select(
            "action", "host", "path", _digest(F.col("host"), F.col("path")).alias("__rule"), _short(_digest(F.col("host"), F.col("path"))).alias("__short")
        )
        if shapes["n"] <= broadcast_rules:
            index = F.broadcast(index)
        rank = F.struct(F.length(F.concat("host", "path")).alias("a"), F.length("host").alias("b"), F.col("action").alias("c"), F.concat("host", "path").alias("rule"))
        best = (
            seen.join(index, "__short").filter("__full = __rule")
            .groupBy("__host", "__path").agg(F.max("__n").alias("__n"), F.max(rank).alias("__best"))
        )
    if best is None:
        out = pages.withColumn("__best", F.lit(None).cast("struct<c:string,rule:string>"))
    else:
        n = pages.count()
        best = staged(best, "rules")
        hot = best.filter(F.col("__n") * HOT > n).select(F.col("__host").alias("__hot_host"), F.col("__path").alias("__hot_path"), F.col("__best").alias("__hot"))
        found = pages.join(F.broadcast(hot), (F.col("__host") == F.col("__hot_host")) & (F.col("__path") == F.col("__hot_path")), "left")
        anywhere = F.col("__hot").isNotNull() | (F.col("__host") == "")  # a null key meets nothing, its other half spreads the rows
        found = found.withColumns({
            "__key": F.when(~anywhere, F.col("__host")), "__rest": F.when(anywhere, F.monotonically_increasing_id().cast("string")).otherwise(F.col("__path")),
        })
        cold = best.filter(F.col("__n") * HOT <= n).select(F.col("__host").alias("__key"), F.col("__path").alias("__rest"), F.col("__best").alias("__cold"))
        out = found.join(cold, ["__key", "__rest"], "left").withColumn("__best", F.coalesce("__hot", "__cold"))
    keep = [F.col(c) for c in taken if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"), F.coalesce("__best.c", F.lit(default)).alias("verdict"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')
), rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url,''),'://') > 0 THEN substr(url, strpos(url,'://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), hit AS (
  SELECT s.page_id, s.host, s.path, u.host || u.path AS rule, u.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(u.host || u.path) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules u ON (s.host = u.host OR ends_with(s.host, '.' || u.host)) AND starts_with(s.path, u.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE n = 1
"""
