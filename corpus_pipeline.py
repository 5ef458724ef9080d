"""A training corpus from raw documents, in five stages; each takes what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellscan.llm import decontam, langid, linededup, mixing, simhash
from tellscan.llm._util import save, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language can't be told go, by the profiles and score floors that docs itself teaches.

    Null texts and texts without letters go; repeated rows fare alike; equal scores go to the first language by name.
    """
    return langid.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: repeated runs of lines go, but for their first place by (doc_id, text hash, line); n_chars follows.

    Every row stays, if with an empty text; null texts stay null. Rows of equal id and text are one document.
    """
    return linededup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near-duplicates stays, the one of the least doc_id.

    Null and wordless texts are one group; of rows that are equal in id and text one stays.
    """
    return simhash.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: contaminated documents go. An empty benchmark contaminates none; null texts are clean."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row for each time a document is drawn, with mix_epoch and mix_pos.

    A null source is a source. Documents without words are drawn with their source; a source without words is not.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: Language profiles and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written and read again. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
