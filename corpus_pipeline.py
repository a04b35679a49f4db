"""The training-data pipeline: five stages over ``documents``, each one call of an operator.

Each stage takes (spark, docs, sf_dir) and returns what it keeps: all stages but the last
return the columns of ``docs``; the last returns the packed pieces.  ``n_chars`` follows the
text where a stage changes it.  SQL can't express the classifier, so ORACLE_SQL is None and
tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.llm import mixing, packing, quality_classifier, simhash, substring_dedup
from spanmask.llm.queries import tokenizer_path
from spanmask.session import ensure_checkpoint_dir

ORACLE_SQL = None


def _with_chars(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted anew from the text."""
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1 (score of 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.fit(docs.select("doc_id", "text"), labels)
    scored = quality_classifier.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where("score >= 0.3").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id."""
    return simhash.one_of_each(docs, "text", "doc_id", k=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words that repeat."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    out = substring_dedup.remove_repeats(docs.select(rest.alias("row"), "text"), "text", 35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cut = out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return _with_chars(cut, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return _with_chars(mixing.mixed_rows(docs, "text", "doc_id", "source"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("source_mixing", mix), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
