"""A training-corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage gets what the one before it kept, written as Parquet and read again,
and all but the last return the columns of ``documents``. Stages keep whole
texts and every row that they do not reject; what they do with null and empty
texts, ties, repeated rows and empty tables is stated by the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.llm import minhash, packing, pii, quality, toxicity
from gridflow.llm.common import cut, ensure_checkpoint_dir, spare, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where(F.col("__quality") >= quality.KEEP).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not graded toxic."""
    return toxicity.grade(docs, table(spark, sf_dir, "labels")).where(F.col("__toxic") < toxicity.REJECT).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays. Rows that repeat a doc_id are one document, the one
    with the smallest text; rows without a doc_id can't be told apart and all stay.
    """
    found = minhash.near_duplicates(docs, minhash.Spec(shingle=5, percent=80))
    kept = cut(found.where("id = component_id").groupBy("id").agg(F.count("*").alias("rows")))
    ids = {k: kept.where(f"rows {k} 1").select("id") for k in ("=", ">")}
    once, again = (docs.join(i, docs["doc_id"] == i["id"], "left_semi") for i in ids.values())
    (whole,) = spare(docs, "whole")
    order = F.struct(F.col("text").isNull(), "text", F.to_json(F.struct(*[docs[c] for c in docs.columns])))
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), order).alias(whole)).select(f"{whole}.*")
    return once.union(again).union(docs.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    out = pii.replace_pii(docs, pii.KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that the documents are packed into, by words."""
    return packing.pack(docs.select("doc_id", packing.words(F.col("text")).alias("length")))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fitted models and hash-dealt groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
