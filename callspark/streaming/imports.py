"""Continuous import and windowed KPIs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import connected
from ..sources.ingest import import_files, literal
from ..sources.store import write_batch


def stream_csv(spark: SparkSession, path: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    """CSV files of a directory as a stream; every column is text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("file_block"),
        )
    )


def import_stream(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    first_batch: int = 0,
) -> StreamingQuery:
    """Standardise, parse and clean the files of each batch and write it as batch ``batch_id``.

    ``rows`` tells which files are new (``file_path``); at most ``files_per_batch`` of them are
    read again, each by its own header and with line ends in quoted fields. Files with one set
    of columns are standardised together. Rows that do not parse go to ``rejected``, files that
    cannot be imported to ``import_errors`` beside the batches, and the stream goes on.

    A replayed batch replaces its own directory only, so the table is right after a
    failure. Later batches win per call when the table is read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, first_batch + batch_id
        files = sorted(literal(unquote(r["file_path"])) for r in batch.select("file_path").distinct().collect())
        if not files:
            return
        good, rejected, errors = import_files(spark, files)
        rejected.write.mode("overwrite").parquet(f"{root}/rejected/batch_seq={number}")
        errors.write.mode("overwrite").parquet(f"{root}/import_errors/batch_seq={number}")
        if good is not None:
            write_batch(good, root, number)
            if on_batch is not None:
                on_batch(spark.read.parquet(f"{root}/batches/batch_seq={number}"), batch_id)

    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def exact_repeats_dropped(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop exact repeats of a call within the delay; it keeps the first copy, so it is
    not a replacement for last-write-wins."""
    return rows.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["call_id"])


def window_kpis(rows: DataFrame, size: str = "1 hour", keys: tuple[str, ...] = ("agent_id",)) -> DataFrame:
    """KPIs per tumbling window and key, for a batch table or, with a watermark, a stream."""
    return (
        rows.groupBy(F.window("timestamp", size).alias("w"), *keys)
        .agg(
            F.count("call_id").alias("calls"),
            F.count_if(connected()).alias("connected_calls"),
            F.avg("duration").alias("avg_duration"),
            F.sum("revenue").alias("total_revenue"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "calls", "connected_calls", "avg_duration", "total_revenue")
    )


def kpi_stream(
    rows: DataFrame, path: str, checkpoint: str, size: str = "1 hour", delay: str = "1 hour"
) -> StreamingQuery:
    """Closed windows appended to a Parquet table; a window closes ``delay`` after its end."""
    return (
        window_kpis(rows.withWatermark("timestamp", delay), size)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
