"""File sources: addresses, a death registry, retrieval benchmarks, plain JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the address files.
ADDRESS_REQUIRED = ("id", "nom_voie", "code_postal", "nom_commune", "lon", "lat")
# Row limits of the acquisition profiles.
PROFILES = {"tiny": 500, "sample": 100_000, "full": None}


class SourceError(ValueError):
    """A file that does not hold what it should."""


def delimiter(spark: SparkSession, path: str) -> str:
    """Comma or semicolon, whichever the header has more of."""
    head = spark.read.text(path).first()
    if head is None:
        raise SourceError("the file is empty")
    return ";" if head[0].count(";") > head[0].count(",") else ","


def addresses(spark: SparkSession, path: str, lenient: bool = False, limit: int | None = None, profile: str | None = None) -> DataFrame:
    """Address rows; unless lenient, a missing column or a bad coordinate is an error."""
    df = spark.read.option("header", True).option("sep", delimiter(spark, path)).option("mode", "DROPMALFORMED" if lenient else "PERMISSIVE").csv(path)
    absent = [c for c in ADDRESS_REQUIRED if c not in df.columns]
    if absent:
        raise SourceError(f"missing columns {absent}")
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    filled = F.lit(True)
    for c in ADDRESS_REQUIRED[:4]:
        filled = filled & (F.coalesce(F.trim(c), F.lit("")) != "")
    good = F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & filled, F.lit(False))
    if not lenient and (bad := df.filter(~good).first()) is not None:
        raise SourceError(f"bad address row {bad['id']}")
    out = df.filter(good).withColumns({"lon": lon, "lat": lat})
    limit = limit or PROFILES.get(profile or "full")
    return out.limit(limit) if limit else out


def address_label(number: Column, suffix: Column, street: Column, postcode: Column, city: Column) -> Column:
    """``[number] street postcode city``; a number and its suffix stand together."""
    house = F.nullif(F.trim(F.concat(F.coalesce(number, F.lit("")), F.coalesce(suffix, F.lit("")))), F.lit(""))
    return F.concat_ws(" ", house, street, postcode, city)


def address_documents(rows: DataFrame) -> DataFrame:
    opt = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    house = F.nullif(F.concat(F.coalesce(opt("numero"), F.lit("")), F.coalesce(opt("rep"), F.lit(""))), F.lit(""))
    return rows.select(
        "id", address_label(opt("numero"), opt("rep"), F.col("nom_voie"), F.col("code_postal"), F.col("nom_commune")).alias("label"), house.alias("house_number"),
        F.col("nom_voie").alias("street_name"), F.col("code_postal").alias("postcode"), opt("code_insee").alias("city_code"),
        F.col("nom_commune").alias("city_name"), F.lit("BAN").alias("source"), F.struct("lat", "lon").alias("location"),
    )


def registry_documents(rows: DataFrame, line: str = "line") -> DataFrame:
    """Registry rows (semicolon CSV) to documents: names split at ``*`` and ``/``, an id from date, act, place and line."""
    name = F.split("nomprenom", r"\*")
    return rows.select(
        F.concat_ws("_", F.lit("ins"), "datedeces", "actedeces", "lieudeces", F.col(line).cast("string")).alias("_id"),
        F.element_at(name, 1).alias("NOM"), F.regexp_replace(F.coalesce(F.try_element_at(name, F.lit(2)), F.lit("")), "/.*$", "").alias("PRENOMS"),
        F.when(F.col("sexe") == "1", "M").when(F.col("sexe") == "2", "F").otherwise(F.col("sexe")).alias("SEXE"), F.col("datenaiss").alias("DATE_NAISSANCE"),
        F.col("commnaiss").alias("COMMUNE_NAISSANCE"), F.col("lieunaiss").alias("CODE_INSEE_NAISSANCE"), F.col("datedeces").alias("DATE_DECES"),
        F.col("lieudeces").alias("COMMUNE_DECES"), F.concat(F.lit("INSEE_"), F.substring("datedeces", 1, 4)).alias("SOURCE"), F.col(line).cast("int").alias("SOURCE_LINE"),
    )


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements above 0) of a retrieval benchmark's folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    qrels = spark.read.option("header", True).option("sep", "\t").csv(f"{path}/qrels/test.tsv").toDF("query_id", "doc_id", "rel")
    return corpus.withColumnRenamed("_id", "id"), queries, qrels.withColumn("rel", F.col("rel").cast("int")).filter("rel > 0")
