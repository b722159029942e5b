"""Continuous scoring of arriving record files. Stateless: no watermark.

One output is exactly-once through the file sink. Two outputs, responses and rejected records, are written batch by batch, each
into the folder of its batch number; a batch that is run again replaces what its first attempt left in either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leakscan.operators.records import CORRUPT, MARKED_REQUEST_SCHEMA
from leakscan.plans.models import LeakModel
from leakscan.plans.scoring import scan_messages, score_incidents, with_rejects

#: Folder and column of a batch's number below either output.
BATCH = "batch_id"


def read_requests(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON-lines request files. Records that do not fit the schema stay, marked as malformed."""
    reader = spark.readStream.schema(MARKED_REQUEST_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(folder)


def write_stream(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Drains what is available to Parquet and stops; started again with the same checkpoint it continues."""
    return (
        df.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_stream(
    source: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, timeout: int | None = None
) -> None:
    """Runs a stateless job over a stream to the end of the available input."""
    query = write_stream(job(source), target, checkpoint)
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError(f"stream to {target} did not finish in {timeout} s")


def write_batch(batch: DataFrame, number: int, job: Callable[[DataFrame], DataFrame], target: str, rejects: str) -> None:
    """Writes both outputs of one batch. The same number again replaces both, so a repeated batch adds nothing."""
    held = batch.persist()
    try:
        for part, folder in zip(with_rejects(held, job), (target, rejects), strict=True):
            part.write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")
    finally:
        held.unpersist()


def run_stream_with_rejects(
    source: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    target: str,
    rejects: str,
    checkpoint: str,
    timeout: int | None = None,
) -> None:
    """Runs a stateless job to the end of the available input; rejected records go to a second table.

    The checkpoint fixes which records a batch number stands for. After a crash the unfinished batch is run again under its
    number, and neither output can hold it twice. Read the tables with ``read_output``.
    """
    query = (
        source.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, job, target, rejects))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError(f"stream to {target} did not finish in {timeout} s")


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """An output of ``run_stream_with_rejects``; the number of its batch is the column ``batch_id``."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/{BATCH}=*")


def score_stream(source: DataFrame, model: LeakModel, target: str, checkpoint: str) -> None:
    """The batch scoring plan over a stream."""
    run_stream(source, lambda df: score_incidents(df, model), target, checkpoint)


def scan_stream(source: DataFrame, target: str, checkpoint: str) -> None:
    """The model-free scan over a stream."""
    run_stream(source, scan_messages, target, checkpoint)


def scan_stream_with_rejects(source: DataFrame, target: str, rejects: str, checkpoint: str) -> None:
    """The model-free scan over a stream, with the rejected records beside it."""
    run_stream_with_rejects(source, scan_messages, target, rejects, checkpoint)
