"""Scoring an unbounded table of records: validate, score, and keep what is rejected.

The query is stateless, so late or repeated input needs no watermark.  Every micro-batch
writes into its own directory named after the batch, in overwrite mode: a batch that is
replayed after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tilth.functions.columns import col
from tilth.operators import scoring
from tilth.operators.linear import LinearModel
from tilth.operators.validation import Contract, reasons

PREDICT, RECOMMEND = "predict", "recommend"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int = 64
) -> DataFrame:
    """Stream of the files that arrive in a folder, with a declared schema."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def parse_requests(texts: DataFrame, contract: Contract, column: str = "value") -> DataFrame:
    """JSON texts to typed fields plus ``request`` (the text) and ``unreadable`` (fields
    that are present but not of their type)."""
    parsed = texts.withColumn("_r", F.from_json(col(column), contract.schema()))
    fields = [F.col("_r")[f].alias(f) for f in contract.fields]
    wrong = [
        F.when(
            F.col("_r")[f].isNull() & F.get_json_object(col(column), f"$.{f}").isNotNull(),
            F.lit(f"{f}:wrong type"),
        )
        for f in contract.fields
    ]
    # a quoted number or boolean is text, whatever its content
    rest = [c for c in texts.columns if c != column]
    return parsed.select(
        *rest, col(column).alias("request"), *fields, F.array_compact(F.array(*wrong)).alias("unreadable")
    )


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """Records with the array ``reasons``; unreadable fields are reported as such."""
    found = reasons(df, contract)
    if "unreadable" in df.columns:
        named = F.transform("unreadable", lambda u: F.concat(F.split_part(u, F.lit(":"), F.lit(1)), F.lit(":missing")))
        found = F.concat(F.array_except(found, named), F.col("unreadable"))
    return df.withColumn("reasons", found)


def score_batch(
    df: DataFrame, model: LinearModel, mode: str, candidates: Sequence[str] = (), candidate: str = "crop"
) -> DataFrame:
    if mode == PREDICT:
        return scoring.predict_explained(df, model)
    if mode == RECOMMEND:
        return scoring.recommend(df, model, candidates, candidate)
    raise ValueError(f"unknown mode {mode!r}")


def score_stream(
    stream: DataFrame,
    model: LinearModel | None,
    contract: Contract,
    out: str,
    rejected: str,
    checkpoint: str,
    mode: str = PREDICT,
    candidates: Sequence[str] = (),
    candidate: str = "crop",
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start scoring.  Without a model nothing is started: the error comes at once."""
    scoring.require_model(model)
    wanted = contract.without(candidate) if mode == RECOMMEND else contract

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = checked(batch, wanted).persist()
        try:
            good = seen.where(F.size("reasons") == 0).drop("reasons", "unreadable")
            scored = score_batch(good, model, mode, candidates, candidate)
            scored.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
            bad = seen.where(F.size("reasons") > 0).drop("unreadable")
            bad.write.mode("overwrite").parquet(os.path.join(rejected, f"batch_id={batch_id}"))
        finally:
            seen.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
