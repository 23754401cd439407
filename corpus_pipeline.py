"""Documents to packed training sequences: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again for the next one.
Stages number rows by file and place in it, so that numbers do not depend on how a scan is split. Rows count as documents of their own, whether their doc_id is missing, repeated or neither.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacancia.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from vacancia.llm.common import numbered, unused
from vacancia.session import checkpoint_dir, cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have too few words and go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles at a similarity of 0.8 or more, the one with the least doc_id, then place.

    Rows without words stay. An empty table gives an empty one.
    """
    (row,) = unused(docs, "row")
    held = numbered(docs, row)
    found = jaccard_join.classes(held.select(F.col(row).alias("doc_id"), "text"), size=5, percent=80)
    others = cut_lineage(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(row), "component_id"))
    grouped = others.unionByName(others.select(F.col("component_id").alias(row), "component_id").distinct())
    ids = held.select(row, "doc_id").join(grouped, row)
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    gone = grouped.select(row).join(least, row, "left_anti")
    return held.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text. Null texts and their n_chars stay as they are."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeated rows are documents of their own, rows without words are not taken."""
    return mixing.mixed(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a long document is several pieces, an empty one has no bin."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources", mixture), ("best-fit packing", packs)]
#: SQL cannot express the group joins, the divergence verdict and the packing; tests compare near duplicates with brute force, the other stages by cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
