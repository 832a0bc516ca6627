"""The stateless operators on a stream of files.

Curation, pairing and grading are column functions, so the batch code runs unchanged on a stream;
there is no state, window or late data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from winnow import schemas


def read_chat_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.CHAT,
    *,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """JSON-lines files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, progress: str
) -> StreamingQuery:
    """Process what has arrived, append Parquet, stop.

    Progress is kept in the folder `progress`, one per `out`: the next run goes on from there.
    """
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
