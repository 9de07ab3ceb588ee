"""Structured Streaming forms of matching and of running cell totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_folder
from ..operators.signals import match_signals
from .cells import totals_of


def stream_match(texts: DataFrame, signals: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """match_signals() of a stream of texts against a static signal table: no state, append output."""
    return match_signals(texts, signals, keys, text_col)


def stream_cells(results: DataFrame, cell: list[str], response_id: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Running responses, incomplete and tokens per cell; a response counts once, state is bounded by the delay.

    Rows later than the delay are dropped. Use update or complete output mode.
    """
    rows = results.withWatermark(at, delay).dropDuplicatesWithinWatermark([response_id])
    return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("responses"), F.count_if("incomplete").alias("incomplete"), F.sum("new_tokens").alias("tokens"))


def drain(stream: DataFrame) -> DataFrame:
    """Runs an append-mode stream over all that is there now and returns what it wrote."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, apply, mode: str = "append", state: str | None = None) -> None:
    """Gives all that is there now to apply(batch, number), batch by batch; state: where the stream's progress is kept."""
    state = state or f"{shared_folder(stream.sparkSession, 'stream')}/state"
    stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def drain_cells(stream: DataFrame, cell: list[str], folder: str | None = None) -> DataFrame:
    """Runs cell_updates() over all that is there now and returns totals_of() what it has written so far; folder: where a
    stream that goes on keeps its state and rows."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    drain_batches(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), "update", f"{folder}/state")
    return totals_of(spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out"), cell)


def drain_totals(stream: DataFrame) -> DataFrame:
    """Runs an aggregating stream over all that is there now and returns its last totals."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
