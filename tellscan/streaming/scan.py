"""The scan over a folder that grows: each file is read once, its notes are appended. No state, so nothing is ever late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tellscan.functions.catalog import Rule
from tellscan.operators.scan import scan


def scan_folder(spark: SparkSession, source: str, target: str, checkpoint: str, rules: Sequence[Rule] | None = None, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Notes of the Parquet files in source that were not read before, appended to target as Parquet."""
    docs = spark.readStream.schema(schema).parquet(source)
    return scan(docs, rules).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
