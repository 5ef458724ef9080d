"""Notes for each thousand words over a stream: each document counts once, in the hour and source that it came in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tellscan.functions.catalog import Rule, select_rules
from tellscan.operators.scan import folded, n_notes

WINDOW, LATE = "1 hour", "2 hours"
SCHEMA = "doc_id long, source string, text string, at timestamp"


def counted(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, source, at, words, notes: what a document adds; its text goes no further."""
    rules = select_rules() if rules is None else list(rules)
    total = sum((n_notes(F.col("text"), r, F.col("low")) for r in rules), F.lit(0)).cast("long")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x09-\x0D ]+")), F.lit(0)).cast("long")
    return docs.withColumn("low", folded(F.col("text"))).select("doc_id", "source", "at", words.alias("words"), total.alias("notes"))


def rates(docs: DataFrame, rules: Sequence[Rule] | None = None, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """start, source, n_docs, words, notes, per_1k for each window of `at`, of a stream or a table.

    A document that comes again within the watermark counts once. State holds a row for each document of the watermark's
    span and for each open window and source. On a stream, a row more than `late` behind is dropped; rows without a time
    never count, documents without an id are one.
    """
    once = counted(docs.where(F.col("at").isNotNull()), rules)
    once = once.withWatermark("at", late).dropDuplicatesWithinWatermark(["doc_id"]) if docs.isStreaming else once.dropDuplicates(["doc_id"])
    got = once.groupBy(F.window("at", window).alias("w"), "source").agg(F.count("*").alias("n_docs"), F.sum("words").alias("words"), F.sum("notes").alias("notes"))
    per = F.when(F.col("words") > 0, F.round(1000 * F.col("notes") / F.col("words"), 6)).otherwise(F.lit(0.0))
    return got.select(F.col("w.start").alias("start"), "source", "n_docs", "words", "notes", per.alias("per_1k"))


def rate_folder(spark: SparkSession, source: str, target: str, checkpoint: str, rules: Sequence[Rule] | None = None, window: str = WINDOW, late: str = LATE, files: int = 1000) -> StreamingQuery:
    """Appends to target, as Parquet, the rates of windows that are closed, from the Parquet files in source that were not read before."""
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    return rates(docs, rules, window, late).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
