"""Operator 8: mixing sources to target weights by temperature. DataFrame functions only.

A source's weight is its share of tokens raised to an exponent, normalised. The exponent is the largest one at which
the entropy of the weights reaches ENTROPY of its maximum, or more where a source would otherwise be read more than
MAX_EPOCHS times. Weights times the budget give each source's tokens. They are realised as permutations: every epoch
deals the rows of a source into blocks of about BLOCK rows by a hash and orders each block by it, full epochs take all
rows, and the last takes rows in that order while they fit. Running totals are formed in blocks and over blocks, never
over a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.llm._util import fresh, save

ENTROPY = 0.98
MAX_EPOCHS = 4.0
#: Tokens drawn, as a multiple of all tokens.
BUDGET = 1.0
BLOCK = 4096
SEED = 42
#: The exponent is found to 2 ** -BITS, with GRID_BITS of them in one job.
BITS, GRID_BITS = 25, 5
#: A token is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
TOKEN = r"[^\x09-\x0D ]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _curves(totals: DataFrame, points: list[float]) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, most readings of a source for one token budget of all tokens)."""
    a = F.col("a")
    grid = totals.where("n_tok > 0").withColumn("a", F.explode(F.array(*map(F.lit, points))))
    share = F.col("n_tok") / F.col("all_tok")
    p = F.pow(share, a)
    sums = grid.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * a * F.log(share)).alias("s"), F.max(p / share).alias("top"))
    return {r.a: (math.log(r.z) - r.s / r.z, r.top / r.z) for r in sums.collect()}  # a row for each point


def exponent(totals: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET) -> float:
    """The exponent for totals (source, n_tok, all_tok), between 0 and 1."""
    n = totals.where("n_tok > 0").count()
    if n < 2:
        return 1.0
    aim = entropy * math.log(n)

    def last_true(holds) -> tuple[float, float]:
        """The step of 2 ** -BITS after which holds() ends, for one that holds at 0 and not at 1."""
        lo, hi = 0.0, 1.0
        for _ in range(BITS // GRID_BITS):
            step = (hi - lo) / 2**GRID_BITS
            points = [lo + step * k for k in range(1, 2**GRID_BITS)]
            at = _curves(totals, points)
            held = [x for x in points if holds(at[x])]
            lo = max(held, default=lo)
            hi = lo + step
        return lo, hi

    ends = _curves(totals, [0.0, 1.0])
    flat_enough, too_often = (lambda c: c[0] >= aim), (lambda c: c[1] * budget > max_epochs)
    by_entropy = 1.0 if flat_enough(ends[1.0]) else last_true(flat_enough)[0]
    by_epochs = 0.0 if not too_often(ends[0.0]) else 1.0 if too_often(ends[1.0]) else last_true(too_often)[1]
    return max(by_entropy, by_epochs)


def _hashed(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.col("did").cast("string")).cast("binary"))


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """did, source, n_tokens, epoch, block, mix_pos: a row for each time a row of docs is drawn.

    mix_pos, from 0 to under 1, is how far through its source's tokens a draw begins; in its order the sources are
    mixed by weight all along. A null source is a source; one without tokens has weight 0 and isn't drawn. Null texts
    have no tokens and are drawn in full epochs, and in the last while any room is left. Repeated rows are drawn each
    for itself; a null id is hashed as an empty one. Rows of one hash are drawn by number of tokens, and as they come
    where that is equal too. An empty table gives an empty result.
    """
    rows = save(docs.select(F.col(id_col).alias("did"), F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("n_tokens")), "mix-tokens")
    per_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("n_tok"), F.count("*").alias("n_rows"))
    whole = per_source.agg(F.sum("n_tok").alias("all_tok"))
    totals = save(per_source.crossJoin(whole), "mix-totals")  # whole is one row
    a = exponent(totals.select("source", "n_tok", "all_tok"), entropy, max_epochs, budget)
    p = F.pow(F.col("n_tok") / F.col("all_tok"), F.lit(a))
    z = totals.where("n_tok > 0").agg(F.sum(p).alias("z"))
    aims = (
        totals.where("n_tok > 0").crossJoin(z)  # one row again
        .withColumn("aim", F.floor(F.round(p / F.col("z"), 9) * F.col("all_tok") * F.lit(budget)).cast("long"))
        .select(F.col("source").alias("src"), "n_tok", "aim", F.floor(F.col("aim") / F.col("n_tok")).cast("int").alias("full"), F.ceil(F.col("n_rows") / block).cast("int").alias("n_blocks"))
        .withColumn("rest", F.col("aim") - F.col("full") * F.col("n_tok"))
    )
    each = rows.join(aims, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    hashed = each.withColumn("h", _hashed(F.col("epoch"))).withColumn("block", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_blocks"))
    keys = ["source", "epoch", "block"]
    inside = Window.partitionBy(*keys).orderBy(F.substring("h", 9, 24), "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = hashed.select("did", *keys, "n_tokens", "h", "n_tok", "aim", "full", "rest")
    sums = slim.groupBy(*keys).agg(F.sum("n_tokens").alias("sum_block"))
    over = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.withColumn("start", F.sum("sum_block").over(over) - F.col("sum_block")).select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "start")
    run = slim.withColumn("upto", F.sum("n_tokens").over(inside))
    placed = run.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b"))).withColumn("upto", F.col("upto") + F.col("start"))
    taken = placed.where((F.col("epoch") < F.col("full")) | (F.col("upto") <= F.col("rest")))
    before = F.col("epoch") * F.col("n_tok") + F.col("upto") - F.col("n_tokens")
    return taken.select("did", "source", "n_tokens", "epoch", "block", F.round(before / F.col("aim"), 9).alias("mix_pos"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, mix_pos for every draw; nulls, ties, repeated rows and empty tables as in draws()."""
    return draws(docs).withColumnRenamed("did", "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as drawn: each row once for each draw, with mix_epoch and mix_pos.

    Rows of one id, source and number of tokens are told apart by nothing, so that all of them come for the least place
    at which one of them is drawn in an epoch; otherwise as draws(). Names that docs has already get underscores.
    """
    epoch, pos, did, source, size = (fresh(docs, c) for c in ("mix_epoch", "mix_pos", "mix_id", "mix_source", "mix_tokens"))
    got = draws(docs, id_col, text_col, source_col, **options)
    once = got.groupBy(F.col("did").alias(did), F.col("source").alias(source), F.col("n_tokens").alias(size), F.col("epoch").alias(epoch)).agg(F.min("mix_pos").alias(pos))
    same = docs[id_col].eqNullSafe(F.col(did)) & docs[source_col].eqNullSafe(F.col(source)) & (tokens(docs[text_col]) == F.col(size))
    return docs.join(once, same).drop(did, source, size)


ORACLE_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS n_tokens FROM documents),
totals AS (
  SELECT source, sum(n_tokens)::BIGINT AS n_tok, count(*) AS n_rows, (SELECT sum(n_tokens) FROM rows_)::BIGINT AS all_tok FROM rows_ GROUP BY source),
src AS (SELECT *, n_tok / all_tok AS share FROM totals WHERE n_tok > 0),
aim AS (SELECT {ENTROPY} * ln(count(*)) AS h, count(*) AS n FROM src),
ent AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (
    SELECT i, lo, hi, ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * (lo + hi) / 2 * ln(share)) / sum(pow(share, (lo + hi) / 2)) >= max(h) AS ok
    FROM ent, src, aim WHERE i < {BITS} GROUP BY i, lo, hi)),
rep AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (
    SELECT i, lo, hi, {BUDGET} * max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) > {MAX_EPOCHS} AS ok
    FROM rep, src WHERE i < {BITS} GROUP BY i, lo, hi)),
x AS (
  SELECT CASE WHEN (SELECT n FROM aim) < 2 THEN 1 ELSE greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) FROM src) >= (SELECT h FROM aim) THEN 1 ELSE (SELECT lo FROM ent WHERE i = {BITS}) END,
    CASE WHEN (SELECT {BUDGET} * max(1 / share) / count(*) FROM src) <= {MAX_EPOCHS} THEN 0
         WHEN {BUDGET} > {MAX_EPOCHS} THEN 1 ELSE (SELECT hi FROM rep WHERE i = {BITS}) END) END AS a),
w AS (
  SELECT source, n_tok, n_rows, floor(round(pow(share, a) / (SELECT sum(pow(share, a)) FROM src, x), 9) * all_tok * {BUDGET})::BIGINT AS aim FROM src, x),
aims AS (
  SELECT source, n_tok, aim, (aim // n_tok)::INT AS f, ceil(n_rows / {BLOCK})::BIGINT AS n_blocks, aim - (aim // n_tok) * n_tok AS rest FROM w),
each_ AS (
  SELECT *, md5('{SEED}:' || epoch::VARCHAR || ':' || doc_id::VARCHAR) AS m
  FROM (SELECT r.doc_id, r.source, r.n_tokens, a.n_tok, a.aim, a.f, a.n_blocks, a.rest, unnest(range(0, a.f + 1))::INT AS epoch FROM rows_ r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source)),
placed AS (
  SELECT *, ('0x' || substr(m, 1, 8))::BIGINT % n_blocks AS block FROM each_),
ran AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block, substr(m, 9, 24), n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM placed)
SELECT doc_id, source, n_tokens, epoch, block, round((epoch * n_tok + upto - n_tokens) / aim, 9) AS mix_pos
FROM ran WHERE epoch < f OR upto <= rest
"""
