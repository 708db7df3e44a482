"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import mixing, near_copies, packing, pii, quality_rules
from loomwell.llm.common import own_prefix, scratch, table
from loomwell.sources.shared import remove, scratch_space


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them. As in all
    stages an empty table stays one, repeated rows are separate documents, texts
    are read whole and other columns pass through whatever their names."""
    return quality_rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word shingles of five, similarity 0.8) stays: the least id's, nulls last."""
    return near_copies.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds; null texts stay null."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; null sources are one source."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of a document with its place in a training sequence; sequence ids
    rise with the training order, a sequence holds documents of one stretch of it."""
    place = own_prefix(docs) + "place"
    return packing.pack(packing.pieces(packing.in_order(docs, place), order=place), order="order").drop("order")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mixture), ("packing", packed)]

#: Estimation by expectation-maximisation is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own files and its input go when its rows are written."""
    df, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with scratch_space(spark):
            stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return df
