"""Operator 3: content-defined chunks of lines; repeated ones are removed. DataFrame functions only.

Lines are hashed; a rolling hash over the hashes of WINDOW successive lines ends a chunk where it is 0 modulo DIVISOR,
so an insertion moves no boundary beyond its neighbourhood. Of the chunks of at least MIN_LINES lines, those of equal
hash are candidates, and their texts are compared byte for byte (they are grouping and join keys). The first
occurrence by (doc_id, text hash, line) stays, all others go, also inside one document. That is op3, as its SQL has it;
repeated lines outside such chunks stay there. The pipeline takes dedup_runs() instead, which cuts no chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.llm._util import fresh, parallelism, save

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
#: Chunks of one hash that are compared in one group; a more frequent hash is dealt to several.
HOT = 10_000
#: The rolling hash is sum(BASE ** k * hash of the k-th last line); line hashes have 28 bits, so nothing overflows.
BASE = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def chunk_ends(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Numbers (from 1) of the lines that end a chunk; the last line always does."""

    def ends(h: Column) -> Column:
        def last(i: Column) -> Column:
            rolled = sum((F.lit(BASE**k) * h[i - 1 - k] for k in range(1, window)), h[i - 1])
            return (i == F.size(h)) | ((i >= window) & (rolled % divisor == 0))

        return F.filter(F.sequence(F.lit(1), F.size(h)), last)

    return let(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")), ends)


def chunks(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """start << 32 | end for each chunk: the lines after the start-th up to the end-th."""
    return let(chunk_ends(lines, window, divisor), lambda e: F.transform(e, lambda x, i: F.shiftleft(F.when(i == 0, F.lit(0)).otherwise(e[i - 1]).cast("long"), 32) + x))


def _start(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _end(code: Column) -> Column:
    return code.bitwiseAND(0xFFFFFFFF).cast("int")


def _text(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, _start(code) + 1, _end(code) - _start(code)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES, out_lines: str = "n_lines", out_removed: str = "n_removed") -> DataFrame:
    """The rows of docs (without columns named as the two numbers) with text_col less its repeated chunks, and the numbers of lines before and removed.

    A null text stays null with 0 lines; an empty one is one empty line. Rows of equal id (null included) and equal
    text are the same document: they get equal results. A document may become empty; its row stays. Every line break
    beside a removed chunk but one goes with it.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (out_lines.lower(), out_removed.lower())))
    did, th, gone = (fresh(docs, c) for c in ("cdc_id", "cdc_text", "cdc_gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = docs.select(F.col(id_col).alias("did"), F.xxhash64(text_col).alias("th"), lines.alias("lines")).where(F.col("lines").isNotNull())
    long_ones = let(F.col("lines"), lambda x: F.transform(F.filter(chunks(x, window, divisor), lambda c: _end(c) - _start(c) >= min_lines), lambda c: F.struct(c.alias("code"), F.xxhash64(_text(x, c)).alias("h"), _text(x, c).alias("body"))))
    pieces = keyed.select("did", "th", F.inline(long_ones))
    place = F.struct("did", "th", "code")
    # one row for each repeated hash; written, so that the join with it can be split where a hash is frequent
    again = save(pieces.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("h", (F.floor(F.col("n") / HOT) + 1).alias("salts")), "chunk-hashes")
    n = parallelism(docs.sparkSession)
    maybe = pieces.join(again.hint("merge"), "h").withColumn("salt", F.pmod(F.xxhash64("did", "th"), F.col("salts"))).repartition(n, "h", "salt")
    some = maybe.groupBy("h", "salt", "body").agg(F.min(place).alias("first"), F.max("salts").alias("salts"))
    first = some.groupBy("h", "body").agg(F.min("first").alias("first"), F.max("salts").alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    removed = maybe.join(first, ["h", "salt", "body"]).where(place != F.col("first")).groupBy("did", "th").agg(F.collect_set("code").alias(gone))
    removed = removed.withColumnsRenamed({"did": did, "th": th})
    same = docs[id_col].eqNullSafe(F.col(did)) & (F.xxhash64(docs[text_col]) == F.col(th))
    joined = docs.join(removed, same, "left")

    def rebuilt(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(chunks(x, window, divisor), F.col(gone)), lambda c: _text(x, c)), "\n")

    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(let(lines, rebuilt))
    n_gone = F.aggregate(F.coalesce(gone, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, c: a + (_end(c) - _start(c)))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    cols = {c: F.col(c) for c in docs.columns} | {text_col: text.alias(text_col)}
    return joined.select(*cols.values(), n_lines.alias(out_lines), n_gone.alias(out_removed))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every row of docs. Of equal chunks the one of the least (doc_id, text hash, line) stays, a null id first."""
    return dedup_lines(docs.select("doc_id", "text"))


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, out_lines: str = "n_lines", out_removed: str = "n_removed") -> DataFrame:
    """As dedup_lines(), but all lines of every repeated run of at least min_lines lines go, wherever chunks would end.

    Each min_lines successive lines are a piece, and a text of fewer lines is one. SHA-256 stands for a piece. Lines of a
    piece that occurred before, by (doc_id, text hash, line), go; so the first occurrence of every line stays.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (out_lines.lower(), out_removed.lower())))
    did, th, gone = (fresh(docs, c) for c in ("run_id", "run_text", "run_gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = docs.select(F.col(id_col).alias("did"), F.xxhash64(text_col).alias("th"), lines.alias("lines")).where(F.col("lines").isNotNull())

    def starts(x: Column) -> Column:
        piece = F.sequence(F.lit(1), F.greatest(F.size(x) - (min_lines - 1), F.lit(1)))
        return F.transform(piece, lambda i: F.struct(i.alias("start"), F.unhex(F.sha2(F.array_join(F.slice(x, i, min_lines), "\n").cast("binary"), 256)).alias("h")))

    pieces = keyed.select("did", "th", F.inline(let(F.col("lines"), starts)))
    place = F.struct("did", "th", "start")
    # written, so that the join with it can be split where a piece is frequent
    first = save(pieces.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first"), "line-pieces")
    removed = pieces.join(first.hint("merge"), "h").where(place != F.col("first")).groupBy("did", "th").agg(F.collect_set("start").alias(gone))
    removed = removed.withColumnsRenamed({"did": did, "th": th})
    joined = docs.join(removed, docs[id_col].eqNullSafe(F.col(did)) & (F.xxhash64(docs[text_col]) == F.col(th)), "left")

    def kept(x: Column) -> Column:
        covered = F.flatten(F.transform(F.col(gone), lambda i: F.sequence(i, F.least(i + (min_lines - 1), F.size(x)))))
        return F.transform(F.array_except(F.sequence(F.lit(1), F.size(x)), covered), lambda i: x[i - 1])

    rest = F.when(F.col(gone).isNotNull(), let(lines, kept))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_rest = F.when(F.col(gone).isNull(), n_lines).otherwise(F.size(rest))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    cols = {c: F.col(c) for c in docs.columns} | {text_col: text.alias(text_col)}
    return joined.select(*cols.values(), n_lines.alias(out_lines), (n_lines - n_rest).alias(out_removed))


def line_dedup(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The columns and rows of docs with texts less their repeated runs of lines; n_chars, where it is a column, follows."""
    a, b = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = dedup_runs(docs, text_col=text_col, out_lines=a, out_removed=b, **options).drop(a, b)
    return out.withColumn("n_chars", F.length(text_col).cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (
  SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM l),
e AS (
  SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR (i >= {WINDOW} AND (h[i] + {BASE} * h[i - 1]) % {DIVISOR} = 0)) AS ends FROM h),
c AS (
  SELECT doc_id, k, CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END AS s, ends[k] AS e, lines
  FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM e)),
t AS (SELECT doc_id, k, e - s AS n, array_to_string(lines[s + 1:e], chr(10)) AS body FROM c),
r AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY body, n >= {MIN_LINES} ORDER BY doc_id, k) > 1 AS gone FROM t),
a AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE kept END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN a USING (doc_id)
"""
