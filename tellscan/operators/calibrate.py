"""How well scores tell two sides apart, how often two runs agree, and whether that is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.operators.judge import settle

#: Fixed value: floors of the cumulative confidence bands.
FLOORS = (0.7, 0.5, 0.0)
#: Questions whose scores must rank machine prose lower, pairs a flip rate needs, its bound, the least agreement.
GATED = ("no-news", "names-nothing")
GATE_AUC, GATE_PAIRS, GATE_FLIP, GATE_AGREE = 0.5, 100, 0.01, 0.9


#: Ranges of scores that a group is cut into.
RANGES = 64


def auc(rows: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """group, n_pos, n_neg, auc: the share of pairs in which the positive row scores higher, ties counting half.

    Rows are summed for each score first. A group's scores are cut into RANGES about equal ranges; a range begins with the
    sum of those below it, and the running count goes on inside it, so no task holds more of a group than a range. A group
    without one of the sides has a null auc, a null group is a group; rows with a null score or side don't count.
    """
    each = rows.groupBy(F.col(group).alias("g"), F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    each = settle(each.where("s is not null and pos + neg > 0"))
    cuts = each.groupBy("g").agg(F.percentile_approx("s", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    dealt = each.join(cuts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select("g", "s", "pos", "neg", F.size(F.filter("cuts", lambda c: c < F.col("s"))).alias("k"))
    before = Window.partitionBy("h").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("g").alias("h"), F.col("k").alias("j")).agg(F.sum("neg").alias("n")).select("h", "j", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("g", "k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(starts, F.col("g").eqNullSafe(F.col("h")) & (F.col("k") == F.col("j")))
    won = counted.withColumn("won", F.col("pos") * (2 * (F.col("start") + F.col("below")) + F.col("neg")))
    got = won.groupBy("g").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    return got.select(F.col("g").alias(group), "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(F.col("won") / (2.0 * F.col("n_pos") * F.col("n_neg")), 9)).alias("auc"))


def agreement(rows: DataFrame, group: str, confidence: str, first: str, second: str) -> DataFrame:
    """group, floor, n, agreed, rate: how often both runs say the same among rows of at least that confidence."""
    same = F.col(first).eqNullSafe(F.col(second))
    sums = [f(F.col(confidence) >= floor, same).alias(f"{name}{k}") for k, floor in enumerate(FLOORS) for name, f in (("n", lambda a, s: F.count_if(a)), ("agreed", lambda a, s: F.count_if(a & s)))]
    bands = F.array(*[F.struct(F.lit(floor).alias("floor"), F.col(f"n{k}").alias("n"), F.col(f"agreed{k}").alias("agreed")) for k, floor in enumerate(FLOORS)])
    return rows.groupBy(group).agg(*sums).select(group, F.inline(bands)).withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("agreed") / F.col("n"), 9)))


def expected_level(probabilities: Column) -> Column:
    """The mean level of a score answer."""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * i), F.lit(0.0), lambda total, x: total + x)


def flag_counts(rows: DataFrame, groups: list[str], flagged: str, confidence: str) -> DataFrame:
    """groups, n_flagged, n: units that a default run reports, of all."""
    return rows.groupBy(*groups).agg(F.count_if(F.col(flagged) & (F.col(confidence) >= 0.5)).alias("n_flagged"), F.count("*").alias("n"))


def flips(rows: DataFrame, group: str, confidence: str, first: str, second: str) -> DataFrame:
    """group, floor, n, flipped, rate: how often the verdict hangs on the order, among pairs of at least that confidence."""
    got = agreement(rows, group, confidence, first, second).withColumn("flipped", F.col("n") - F.col("agreed"))
    return got.select(group, "floor", "n", "flipped", F.when(F.col("n") > 0, F.round(F.col("flipped") / F.col("n"), 9)).alias("rate"))


def gates(aucs: DataFrame, flipped: DataFrame, agreed: DataFrame) -> DataFrame:
    """gate, subject, status (ok, FAIL, n/a), value, n. aucs: rule, auc; flipped and agreed as from flips and agreement."""
    floor = F.col("floor") == FLOORS[0]
    ranked = aucs.where(F.col("rule").isin(*GATED)).select(F.lit("auc").alias("gate"), F.col("rule").alias("subject"), F.when(F.col("auc") < GATE_AUC, "ok").otherwise("FAIL").alias("status"), F.col("auc").alias("value"), F.lit(None).cast("long").alias("n"))
    few, f_rate = F.coalesce(F.sum("n"), F.lit(0)), F.sum("flipped") / F.sum("n")
    turned = flipped.where(floor).agg(F.when(few < GATE_PAIRS, "n/a").when(f_rate < GATE_FLIP, "ok").otherwise("FAIL").alias("status"), F.when(few > 0, F.round(f_rate, 9)).alias("value"), few.alias("n"))
    a_n = F.coalesce(F.sum("n"), F.lit(0))
    a_rate = F.when(a_n > 0, F.sum("agreed") / F.sum("n"))
    same = agreed.where(floor).agg(F.when(a_rate >= GATE_AGREE, "ok").otherwise("FAIL").alias("status"), F.round(a_rate, 9).alias("value"), a_n.alias("n"))
    named = [df.select(F.lit(g).alias("gate"), F.lit(s).alias("subject"), "status", "value", "n") for g, s, df in (("flip", "compare", turned), ("agreement", "check", same))]
    return ranked.unionByName(named[0]).unionByName(named[1])
