"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame;
all but the last return the columns of ``documents``. A runner writes each result as Parquet and
reads it back as the next stage's input, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runloom.llm import language, packing, simhash, toxicity
from runloom.llm.common import fold
from runloom.llm.registry import table, vocabulary
from runloom.session import shared_path

TOXIC_SCORE = 0.3  # documents at or above it go, as op7_toxicity predicts
LANGUAGE_SHARE = 0.3  # documents whose first language has less go, and those without a letter; three equal ones stay


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that no result's name can clash with theirs."""
    return F.struct(*docs.columns).alias("row")


def both_classes(docs: DataFrame, labels: DataFrame) -> bool:
    """Whether there are documents of both labels to count and, in another fold, to calibrate with."""
    held_back = (fold(F.col("doc_id"), 4) == 3).alias("held_back")
    marked = docs.select("doc_id", held_back).join(labels.select("doc_id", "toxic"), "doc_id")
    found = marked.groupBy("held_back").agg(F.count_distinct(F.col("toxic") > 0).alias("classes")).where("classes = 2")
    return found.count() == 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models, learned from the labels, find ordinary; all where nothing can be learned."""
    part, labels = fold(F.col("doc_id"), 4), table(spark, sf_dir, "labels")
    scored = toxicity.detect(docs, labels, for_model=part != 3, for_calibration=part == 3, keep=[whole_row(docs)])
    if not both_classes(docs, labels) and scored.where(F.col("score") != 0.5).isEmpty():
        return docs
    return scored.where(F.col("score") < TOXIC_SCORE).select("row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words few languages explain, of those that the corpus names; all where it names none."""
    names, model = language.learn(docs)
    if not names:
        return docs
    found = language.identify(docs, names, model, keep=[whole_row(docs)])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("share") >= LANGUAGE_SHARE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: 160 of 192 fingerprint bits alike, as at a five-word similarity of 0.8."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens with the sources in their proportions; a row per piece with its ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_identified), ("near_copies", drop_near_copies), ("packing", pack)]

# Trained models and exact merges decide, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
