"""A training corpus in five stages: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and reads whole texts. All but the last
return the columns of docs: the mixing stage keeps every row and lays the rows
out in mixture order over its files; the last cuts that order into WINDOWS and returns
each document's place in the shards, which follow the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, hilbert_sharding, minhash_dedup, pfair_mixing, quality_classifier
from lodestone.llm.common import Scratch, read_table

#: Runs of the mixture that are sharded one after another.
WINDOWS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; the fit leaves out the held-out fold, as in op6."""
    weights = quality_classifier.fit_on_training_fold(docs, read_table(spark, sf_dir, "labels"))
    held = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*held).alias("_row"), "text")
    scored = quality_classifier.score(packed, weights, id_column="_row", carry=("text",))
    good = scored.where(F.col("score") >= quality_classifier.THRESHOLD)
    return good.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.keep_one(docs, k=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixture order, by op5's target weights: large sources come late beyond their target."""
    return pfair_mixing.mixed_order(docs, pfair_mixing.TEMPERATURE)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot: windows of the mixture as the files have it, in each along the Hilbert curve."""
    return hilbert_sharding.shard(hilbert_sharding.file_positions(docs, "_mixed"), order="_mixed", windows=WINDOWS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mixture", mixture), ("shards", shards)]

#: The classifier's fit and the hashes of the order have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
