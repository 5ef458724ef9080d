"""Operator 1: logged conversations collapsed to maximal ones and rendered. DataFrame functions only.

Chat logs hold a snapshot after every turn, so most conversations are prefixes of longer ones. Each turn gets the hash
of all turns up to it (a rolling sum of hashes that include the place), the hashes of proper prefixes are set against
those of whole conversations in an anti-join, and what is left is rendered.

Places and sums are formed in segments of SEGMENT turn numbers and then over segments, so that a conversation of any
length is no single unit of work; it is also rendered in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.llm._util import save

SEGMENT = 64
#: ChatML markers, fixed by the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: A marker inside a text is broken up, so that it can't end a turn.
UNSAFE, SAFE = "<|", "< |"


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _numbered(conv: DataFrame, segment: int) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), role, text."""
    turns = conv.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("seg", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 62))))
    sizes = turns.groupBy("conv_id", "seg").agg(F.count("*").alias("k"))
    along = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), (F.sum("k").over(along) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("conv_id")).alias("n"))
    inside = Window.partitionBy("conv_id", "seg").orderBy("turn", "role", "text")
    placed = turns.withColumn("at", F.row_number().over(inside))
    return placed.join(starts, _same(placed.conv_id, F.col("c")) & (F.col("seg") == F.col("s"))).select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "n", "role", "text")


def _prefixes(turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, pos, n, and the four sums that stand for the turns up to pos."""
    a, b = F.xxhash64("pos", "role", "text"), F.xxhash64("text", "pos", F.lit(1), "role")
    halves = {"p0": F.shiftrightunsigned(a, 32), "p1": a.bitwiseAND(0xFFFFFFFF), "p2": F.shiftrightunsigned(b, 32), "p3": b.bitwiseAND(0xFFFFFFFF)}
    each = turns.select("conv_id", "pos", "n", F.floor(F.col("pos") / segment).alias("seg"), *[v.alias(k) for k, v in halves.items()])
    sums = each.groupBy("conv_id", "seg").agg(*[F.sum(k).alias(k) for k in halves])
    along = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), *[(F.sum(k).over(along) - F.col(k)).alias(f"{k}_before") for k in halves])
    inside = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.select("conv_id", "pos", "n", "seg", *[F.sum(k).over(inside).alias(k) for k in halves])
    return run.join(starts, _same(run.conv_id, F.col("c")) & (F.col("seg") == F.col("s"))).select("conv_id", "pos", "n", *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in halves])


KEY = ["n", "p0", "p1", "p2", "p3"]


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n, copies: conversations that are no proper prefix of another; of equal ones the smallest id stands for all."""
    whole = prefixes.where("pos = n").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.where("pos < n").select(F.col("pos").alias("n"), *KEY[1:]).distinct()
    return whole.join(proper, KEY, "left_anti").select("conv_id", "n", "copies")


def collapse(conv: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, part, n_turns, copies, rendered for every maximal conversation, in parts of at most segment turns.

    Turns are in order of turn number (null first), role and text; a repeated row is a turn of its own. Null roles and
    texts are empty ones; rows without conv_id form one conversation. copies counts the equal conversations. Columns
    other than conv_id, turn, role and text have no part in it. An empty table gives an empty result.
    """
    turns = save(_numbered(conv, segment), "chat-turns")
    kept = maximal(save(_prefixes(turns, segment), "chat-prefixes")).select(F.col("conv_id").alias("c"), "copies")
    safe = F.replace(F.col("text"), F.lit(UNSAFE), F.lit(SAFE))
    line = F.concat(F.lit(OPEN), F.replace(F.col("role"), F.lit(UNSAFE), F.lit(SAFE)), F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    lines = turns.join(kept, _same(turns.conv_id, F.col("c"))).select("conv_id", "n", "copies", F.floor((F.col("pos") - 1) / segment).alias("part"), F.struct("pos", line.alias("line")).alias("x"))
    parts = lines.groupBy("conv_id", "part", "n", "copies").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most segment turns each
    return parts.select("conv_id", "part", F.col("n").alias("n_turns"), "copies", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("rendered"))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, pos, n, string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
w AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY prefix, n),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.prefix = w.prefix))
SELECT t.conv_id, (t.pos - 1) // {SEGMENT} AS part, t.n AS n_turns, m.copies,
       string_agg('{OPEN}' || replace(t.role, '{UNSAFE}', '{SAFE}') || chr(10) || replace(t.text, '{UNSAFE}', '{SAFE}') || '{CLOSE}' || chr(10), '' ORDER BY t.pos) AS rendered
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY 1, 2, 3, 4
"""
