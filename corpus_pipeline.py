"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. The first four return the columns of ``documents``; the last returns the
piece ids of what is left.

All stages judge each row by its own text, so null and repeated ids do no harm;
null and empty texts are scored as documents without words, are no duplicates,
hold no benchmark item and no secret; texts are read whole,
however long; columns beyond those of ``documents`` are carried along, whatever
their names; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import op03_neardup, op04_pieces, op07_toxicity, op09_decontaminate, op10_secrets
from massloom.plans.store import discard, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; labels of held-out rows are not learned from.

    A score of exactly 0.5 is toxic; repeated rows share a fate; without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op07_toxicity.drop_toxic(docs, labels.filter(~op07_toxicity.held_out(F.col("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id (a null one first).

    Repeated rows are copies of each other, so one stays; of rows of one id in a group the first read stays.
    """
    return op03_neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; three quarters of its shingles exactly count, repeated rows share a fate."""
    return op09_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; every document stays, repeated rows each for itself. n_chars follows the text."""
    return op10_secrets.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text: null ids for a null text, none for an empty one."""
    return op04_pieces.encode_documents(docs).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pieces", pieces)]

#: The stages learn models, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES[:-1]:
        left = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if own:
            discard(docs)  # its rows are in the next table now
        docs, own = left, True
    return STAGES[-1][1](spark, docs, sf_dir)
