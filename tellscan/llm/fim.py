"""Operator 12: fill-in-the-middle, by DuckDB inside mapInArrow.

A text is cut into units, runs of letters and single other characters. Two draws from a hash of the document's id choose
where its prefix and its middle end, two more whether it stays plain and which order its parts take: prefix, suffix,
middle (psm) or suffix, prefix, middle (spm). Each batch of rows is registered with a DuckDB in the worker, and one
statement cuts, draws and joins; no row passes through Python by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.llm import duck
from tellscan.llm._util import fresh

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are taken apart, and percent of these that lead with their suffix.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: What comes with a document, by DuckDB's and Spark's types.
FIELDS = {"fim_units": ("long", pa.int64()), "fim_form": ("string", pa.string()), "fim_prefix_chars": ("long", pa.int64()), "fim_middle_chars": ("long", pa.int64()), "fim_text": ("string", pa.string())}


def statement(rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> str:
    """DuckDB SQL over batch(pos, id, body): a row for each, in order."""
    draw = "('0x' || substr(h, {}, 8))::UBIGINT"
    return f"""
WITH cut AS (
  SELECT pos, body, regexp_extract_all(body, '{UNIT}') AS units, sha256('{seed}:' || id) AS h FROM batch),
drawn AS (
  SELECT *, len(units) AS n, {draw.format(1)} % (len(units) + 1)::UBIGINT AS one, {draw.format(9)} % (len(units) + 1)::UBIGINT AS two,
         CASE WHEN body = '' OR contains(body, '{PREFIX}') OR contains(body, '{SUFFIX}') OR contains(body, '{MIDDLE}') OR {draw.format(17)} % 100 >= {rate} THEN 'plain'
              WHEN {draw.format(25)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT pos, body, n, form,
         array_to_string(list_slice(units, 1, least(one, two)::BIGINT), '') AS prefix,
         array_to_string(list_slice(units, least(one, two)::BIGINT + 1, greatest(one, two)::BIGINT), '') AS middle,
         array_to_string(list_slice(units, greatest(one, two)::BIGINT + 1, n), '') AS suffix
  FROM drawn)
SELECT pos, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END, CASE WHEN form <> 'plain' THEN length(middle) END,
       CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                 ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END
FROM parts ORDER BY pos"""


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Every row and column of docs with fim_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_text.

    A null text is an empty one, and stays plain with no units, as do texts that hold one of the markers; the lengths of
    a plain one are null. A null id draws as the id "null"; rows of one id draw alike. Bytes that are no UTF-8 are read
    as U+FFFD. Where docs has a column of one of these names, the new one has an underscore before it. Nothing is
    shuffled, and a worker holds a few megabytes of text, or one text, at a time.
    """
    id_, body = fresh(docs, "fim_id"), fresh(docs, "fim_body")
    names = {fresh(docs, c): kinds for c, kinds in FIELDS.items()}
    given = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("string"), F.lit("null")), body: F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    sql = statement(rate, suffix_first, seed)
    types = {name: kinds[1] for name, kinds in names.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in duck.slices(batches, body):
            found = duck.ask(sql, duck.numbered(rows, [id_, body]).rename_columns(["pos", "id", "body"]))
            yield duck.joined(rows, found, types)

    return given.mapInArrow(run, duck.with_columns(given, {name: kinds[0] for name, kinds in names.items()})).drop(id_, body)


def restored(text: Column, form: Column) -> Column:
    """The text that a fim_text of that form was made of. No part holds a marker, so the first one of each kind is the one set."""

    def between(start: str, end: str | None) -> Column:
        since = F.instr(text, F.lit(start)) + len(start)
        return F.substring(text, since, (F.instr(text, F.lit(end)) if end else F.length(text) + 1) - since)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of what came out and of what is restored from it."""
    out = transform(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                      F.sha2(F.col("fim_text"), 256).alias("output_sha256"), F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')) AS n
  FROM documents),
r AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
         t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 20 AS lead
  FROM d),
u AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')) AS w, unnest(range(1, n + 1)) AS i, least(x, y) AS a, greatest(x, y) AS b FROM r WHERE NOT plain),
p AS (
  SELECT doc_id, (sum(length(w)) FILTER (i <= a))::BIGINT AS pc, (sum(length(w)) FILTER (i > a AND i <= b))::BIGINT AS mc FROM u GROUP BY doc_id),
o AS (
  SELECT r.doc_id, n, t, CASE WHEN plain THEN 'plain' WHEN lead THEN 'spm' ELSE 'psm' END AS form,
         CASE WHEN NOT plain THEN coalesce(pc, 0) END AS pc, CASE WHEN NOT plain THEN coalesce(mc, 0) END AS mc
  FROM r LEFT JOIN p USING (doc_id))
SELECT doc_id, n::BIGINT AS n, form, pc::BIGINT AS prefix_chars, mc::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, pc) || '<S>' || substr(t, pc + mc + 1) || '<M>' || substr(t, pc + 1, mc)
                        ELSE '<S>' || substr(t, pc + mc + 1) || '<P>' || substr(t, 1, pc) || '<M>' || substr(t, pc + 1, mc) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
