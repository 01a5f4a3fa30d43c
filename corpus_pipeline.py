"""From raw documents to packed training sequences: toxic documents go, near-duplicates go, personal data is masked, the
rest is packed.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import pii, toxicity
from tidepool.llm.common import table, written
from tidepool.llm.packing import best_fit_packing
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.simhash import near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.5 or more go.  Labels are learned from as in the operator's query; a document's own
    label, source and language have no say."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    renamed = docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs
    kept = toxicity.scores(renamed, model).where("score < 0.5").drop("score")
    return kept.withColumnRenamed("_score", "score") if "_score" in kept.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Near-duplicates are those of op6: fingerprints of 4-word shingles that differ in at most 4 bits.  On random-word texts
    of 200 words that links 7 % of the pairs of 5-word Jaccard 0.81 and 30 % of those of 0.90 (300 pairs each), so most
    edited copies of that likeness stay.

    Rows are told apart by where they stand in ``docs``, a table that is read again as it is, so ids may repeat or be null:
    of each group the row with the smallest id stays, a null last, and of several the first.  Only places, ids and
    fingerprints are grouped; texts meet the places that stay."""
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    groups = near_duplicates(placed, keep=("_place",))
    best = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "_place")).alias("best"))
    stay = written(best.select(F.col("best._place").alias("_place")), "stay")
    return placed.join(stay.hint("merge"), "_place", "left_semi").select(*docs.columns)  # places are as many as documents: never broadcast


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars follows the text."""
    out = pii.masked(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    return best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", mask_personal_data), ("packing", pack)]

#: The model stages have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
