"""Scanning a corpus that keeps growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CORPUS_SCHEMA = "path string, text string"


def read_corpus_stream(
    spark: SparkSession, folder: str, files_per_batch: int = 1000
) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return (
        spark.readStream.schema(CORPUS_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def start_scan(
    scan: Callable[[DataFrame], DataFrame],
    arriving: DataFrame,
    target: str,
    name: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append what ``scan`` finds in arriving rows to a Parquet folder, with the log
    of the stream in the folder ``checkpoint``; both must be shared.

    Scans are stateless, so there is no watermark and nothing to keep between
    batches but the log of files already read.  The file sink records each
    batch, so a batch that is repeated after a failure is not written twice.
    """
    return (
        scan(arriving)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
