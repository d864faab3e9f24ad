"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the model rejects (score of 0.5 or more) go.
2. near_dedup: of each group of near duplicates one document stays.
3. decontaminate: documents that hold a benchmark item go.
4. pii: personal data is replaced by placeholders; every document stays.
5. pack: the rest is tokenised and packed into sequences.

All but the last return the columns they were given. Rows are decided by themselves: a null or repeated doc_id neither
saves nor drops another row. Null and empty texts are clean and stay; an empty table gives an empty one. Very long texts
are judged whole; repeated rows stay once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, near_dedup, packing, pii, toxicity
from quillstone.llm._common import short_batches, staged


#: Jaccard similarity of five-word shingles, in per cent, from which documents are near duplicates.
NEAR = 80


def _row_key() -> Column:
    """Tells rows apart for a stage's decision: doc_id (null or not) and text. Rows that repeat both are decided alike."""
    return F.xxhash64("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__toxic", keep_text=True).filter("__toxic < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays (repeated doc_ids or not); rows without a word stay, rows that repeat both doc_id and text once."""
    found = staged(near_dedup.near_duplicates(docs, percent=NEAR), "kept")
    gone = staged(found.filter("not chosen").select(F.xxhash64("doc_id", "text_hash").alias("__gone")).distinct(), "gone")  # small, so that its size is known
    kept = docs.join(gone, F.xxhash64("doc_id", F.xxhash64("text")) == F.col("__gone"), "left_anti").select(*docs.columns)
    chosen = found.filter("chosen").select("doc_id", "text_hash")
    return kept.dropDuplicates(["doc_id", "text"]) if chosen.count() != chosen.distinct().count() else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose own text holds an item, whatever other rows of their doc_id hold."""
    rows = docs.select(_row_key().alias("doc_id"), "text")
    found = staged(decontaminate.matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")
    leaks = staged(found.select(F.col("doc_id").alias("__leak")).distinct(), "leaking")
    return docs.join(leaks, _row_key() == F.col("__leak"), "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with short_batches(docs.sparkSession):
        found = staged(packing.pieces(docs), "pieces")
    placed = packing.pack(found)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("pack", pack_sequences),
]

#: No stage but pii can be put in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
