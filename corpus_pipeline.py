"""The corpus pipeline: documents are judged, deduplicated, cleaned of repeats, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of documents.
Null texts are empty texts throughout; empty tables pass through every stage; extra columns
are carried along; rows of null or repeated ids are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tilth.llm import minhash, mixing, pieces, quality, repeats
from tilth.session import staged

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model is learnt from the labels."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, 0.8)."""
    return minhash.keep_one(docs)


def strip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat 100 bytes or more of what stands earlier."""
    return repeats.stripped(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each mixed document's piece ids, and whether they decode to its text."""
    return pieces.encode(docs, MODEL, carry=["doc_id", "source"])


STAGES = [("judge", judge), ("one_of_each", one_of_each), ("strip", strip), ("mix", mix), ("encode", encode)]

#: The weights of the classifier and the shortest paths of the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
