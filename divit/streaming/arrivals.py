"""Jobs on arriving files: a stateless stream that runs over what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_arrivals(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Transform every new Parquet file of `source` once into `target`; the checkpoint remembers which are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
