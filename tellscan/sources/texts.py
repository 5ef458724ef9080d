"""Texts from files: whole text files, lines of JSON, CSV with headers and Parquet by an id's prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text), a row for each file; a file that isn't UTF-8 fails the job."""
    raw = spark.read.format("binaryFile").load(paths)
    bad = F.raise_error(F.concat(F.col("path"), F.lit(" is not valid UTF-8")))
    body = F.decode("content", "UTF-8")
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), body).otherwise(bad.cast("string")).alias("text"))


def one_text(spark: SparkSession, raw: bytes, path: str = "-") -> DataFrame:
    """(path, text) of bytes that were read already, as from standard input; bytes that aren't UTF-8 are an error."""
    try:
        return spark.createDataFrame([(path, raw.decode())], "path string, text string")
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not valid UTF-8") from e


def require_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, or an error if every text is blank."""
    if docs.where(F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S"))).isEmpty():
        raise ValueError("every text is empty")
    return docs


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold line breaks; a doubled quote stands for one."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The rows of csv_with_header(), but a large file is read in many tasks.

    A line break inside quotes ends no record, so whether a line begins one hangs on all quotes before it. Their number is
    summed up block by block of the file, then line by line inside a block; lines of a record are put together again and
    parsed. No task holds more than a block, or one record. Quotes must stand as RFC 4180 has them, doubled inside fields.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("held"))
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("own", F.coalesce(F.sum("quotes").over(inside), F.lit(0))).join(blocks, ["file", "block"])
    marked = marked.withColumn("starts", F.pmod(F.col("own") + F.col("held"), F.lit(2)) == 0)
    # the number of a record is that of the starts up to its lines
    upto = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    starts = marked.groupBy("file", "block").agg(F.count_if("starts").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("records"))
    numbered = marked.withColumn("nth", F.count_if("starts").over(upto)).join(starts, ["file", "block"]).withColumn("record", F.col("records") + F.col("nth"))
    whole = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n").alias("csv"))
    # the first record of a file is its header; a blank line is none
    rows = whole.where("record > 1").select(F.regexp_replace("csv", r"\r\z", "").alias("csv")).where("csv <> ''")
    return rows.select(F.from_csv("csv", schema, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")


def by_prefix(spark: SparkSession, path: str, prefix: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns of a Parquet table, only ids that begin with prefix; the filter reaches the scan."""
    return spark.read.parquet(path).select(id_col, text_col).where(F.col(id_col).startswith(prefix))
