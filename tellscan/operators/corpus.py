"""Human prose against a model's: units scored twice, passages compared in both orders, and what becomes of the scores.

Texts have a source_id (what both sides wrote about), a side and a register; HUMAN is the side the others are held against.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellscan.functions.catalog import Rule, select_rules
from tellscan.functions.questions import Question
from tellscan.operators.backend import Backend, each
from tellscan.operators.calibrate import agreement, auc, flips, gates
from tellscan.operators.judge import MEDIUM, MIN_SENTENCES, compare
from tellscan.operators.scan import folded, n_notes, scan
from tellscan.operators.split import split

HUMAN = "human"
#: Fixed value: paragraphs of a text that are scored.
PARAGRAPHS = 2
SCORED = "rule string, score double, flagged boolean, confidence double, flagged_again boolean"


def sampled(texts: DataFrame, n: int) -> DataFrame:
    """The human texts of the n least source_ids, and all others about the same; a null source_id is about nothing."""
    ids = texts.where(F.col("side") == HUMAN).select("source_id").where("source_id is not null").distinct().orderBy("source_id").limit(n)
    return texts.join(ids, "source_id", "left_semi")


def units(texts: DataFrame, key: str = "text_id") -> DataFrame:
    """key, place, asked, sentences: the first PARAGRAPHS paragraphs of MIN_SENTENCES and more of each text."""
    rows = split(texts, key).where(F.size("sentences") >= MIN_SENTENCES)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("paragraph"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= PARAGRAPHS).select(key, (F.col("nth") - 1).alias("place"), "asked", "sentences")


def chosen(rows: DataFrame, **values: str | list[str] | None) -> DataFrame:
    """The rows whose columns have the given values, or one of several; None asks for nothing. Columns that rows lacks are an error."""
    for name, value in values.items():
        if name not in rows.columns:
            raise ValueError(f"no column {name}")
        if value is not None:
            rows = rows.where(F.col(name).isin(value))
    return rows


def common(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """The different values of columns that both have; nulls are equal to each other."""
    return left.select(*columns).intersect(right.select(*columns))


def lacking(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """The values of columns in left less as many as right has, repeats counted; nulls are equal to each other."""
    return left.select(*columns).exceptAll(right.select(*columns))


def rates(texts: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """domain, side, n_texts, words, notes, per_1k: notes of the rules for each thousand words; 0 where there are no words."""
    rules = select_rules() if rules is None else list(rules)
    counted = texts.withColumn("low", folded(F.col("text"))).select("domain", "side", F.coalesce(F.regexp_count("text", F.lit(r"[^\x09-\x0D ]+")), F.lit(0)).cast("long").alias("words"), sum((n_notes(F.col("text"), r, F.col("low")) for r in rules), F.lit(0)).cast("long").alias("notes"))
    got = counted.groupBy("domain", "side").agg(F.count("*").alias("n_texts"), F.sum("words").alias("words"), F.sum("notes").alias("notes"))
    return got.withColumn("per_1k", F.when(F.col("words") > 0, F.round(1000 * F.col("notes") / F.col("words"), 6)).otherwise(F.lit(0.0)))


def first_notes(texts: DataFrame, n: int, rules: Sequence[Rule] | None = None, side: str = HUMAN) -> DataFrame:
    """rule, domain, place, source_id, line, column, context: the first n notes of each rule and domain in the texts of a side."""
    found = scan(texts.where(F.col("side") == side).select(F.struct("source_id", "domain").alias("text_of"), "text"), rules, key="text_of")
    place = F.row_number().over(Window.partitionBy("rule", "domain").orderBy("source_id", "line", "column"))
    rows = found.select("rule", "text_of.*", "line", "column", "context").withColumn("place", place).where(F.col("place") <= n)
    return rows.select("rule", "domain", "place", "source_id", "line", "column", "context")


def scored(units: DataFrame, backend: Backend, again: Backend, questions: Sequence[Question], unit: str = "paragraph", text: str = "asked", register: str = "register") -> DataFrame:
    """The columns of units but text, and rule, score, flagged, confidence, flagged_again for each question about such a unit.

    score is the mean of the levels by their probabilities; the worst level is 0. Both backends are asked once a unit, all questions at once.
    Units without a text are left out.
    """
    asked = [q for q in questions if q.unit == unit]
    others = [c for c in units.columns if c != text]
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*others).schema)

    def flagged(q: Question, p: list[float]) -> bool:
        return [i for i, x in enumerate(p) if x == max(p)] == [q.flag_level]

    def judged(job: tuple) -> list[tuple]:
        body, reader = job
        what = {q.id: q.asked(reader) for q in asked}
        about = {"paragraph": body} if unit == "paragraph" else {"paragraph": {"sentences": [body]}, "target_index": 0, "target": body}
        one, two = (b.ask({"register": reader, **about}, what) for b in (backend, again))
        return [(q.id, sum(p * i for i, p in enumerate(one[q.id].probabilities)), flagged(q, one[q.id].probabilities), one[q.id].confidence, flagged(q, two[q.id].probabilities)) for q in asked]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = each(backend, zip(f[text], f[register], strict=True), judged)
            at = [i for i, rows in enumerate(got) for _ in rows]
            out = f[others].iloc[at].reset_index(drop=True)
            found = pd.DataFrame([r for rows in got for r in rows], columns=["rule", "score", "flagged", "confidence", "flagged_again"])
            yield pd.concat([out, found], axis=1)

    return units.where(F.col(text).isNotNull()).mapInPandas(run, f"{plain}, {SCORED}")


def rank_auc(scores: DataFrame) -> DataFrame:
    """register, side, rule, n_pos, n_neg, auc: how often a unit of a side scores higher than a human one of its register."""
    keys = ["register", "rule"]
    sides = scores.where(F.col("side") != HUMAN).select(*keys, "side").distinct()
    human = scores.where(F.col("side") == HUMAN).drop("side").join(sides, keys).withColumn("model", F.lit(False))
    both = scores.where(F.col("side") != HUMAN).withColumn("model", F.lit(True)).unionByName(human)
    got = auc(both.withColumn("group", F.struct("register", "side", "rule")).withColumn("score", F.round("score", 9)), "group", "score", "model")
    return got.select("group.*", "n_pos", "n_neg", "auc")


def flagged_units(scores: DataFrame) -> DataFrame:
    """register, side, rule, n_flagged, n: units that a check reports, of all."""
    return scores.groupBy("register", "side", "rule").agg(F.count_if(F.col("flagged") & (F.col("confidence") >= MEDIUM)).alias("n_flagged"), F.count("*").alias("n"))


def pairs_of(firsts: DataFrame) -> DataFrame:
    """pair_id, register, side, a, b: each side's first unit with the human one about the same. firsts: source_id, register, side, asked."""
    human = firsts.where(F.col("side") == HUMAN).select("source_id", "register", F.col("asked").alias("a"))
    return firsts.where(F.col("side") != HUMAN).withColumnRenamed("asked", "b").join(human, ["source_id", "register"]).select(F.concat_ws("/", "register", "side", "source_id").alias("pair_id"), "register", "side", "a", "b")


def both_orders(pairs: DataFrame, backend: Backend, place: str = "for a reader who works in the field") -> DataFrame:
    """register, side, keep, keep_again, confidence: the verdict on each pair in both orders, and the lesser confidence."""
    one, two = (compare(pairs, backend, place=place, swap=F.lit(s)).select("pair_id", F.col("keep").alias(f"keep{s:d}"), F.col("keep_confidence").alias(f"sure{s:d}")) for s in (False, True))
    both = pairs.select("pair_id", "register", "side").join(one, "pair_id").join(two, "pair_id")
    return both.select("register", "side", F.col("keep0").alias("keep"), F.col("keep1").alias("keep_again"), F.least("sure0", "sure1").alias("confidence"))


def calibration(scores: DataFrame, turned: DataFrame, side: str, register: str) -> DataFrame:
    """The gate lines of one side and register, from scored() and both_orders()."""
    ranked = rank_auc(scores).where((F.col("side") == side) & (F.col("register") == register)).select("rule", "auc")
    return gates(ranked, flips(turned, "register", "confidence", "keep", "keep_again"), agreement(scores, "register", "confidence", "flagged", "flagged_again"))


def append_texts(texts: DataFrame, folder: str, batch: str | None = None) -> None:
    """Lines of JSON by domain, side and batch, beside those that are there; the same batch again takes the place of what it wrote.

    A batch that isn't named is named after its rows, whatever their order, so a call that is retried leaves them once.
    """
    if batch is None:
        batch = str(texts.agg(F.coalesce(F.sum(F.xxhash64(*sorted(texts.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h"), F.count("*").alias("n")).select(F.sha2(F.concat_ws("/", "h", "n"), 256)).first()[0])[:32]
    texts.withColumn("batch", F.lit(batch)).write.partitionBy("domain", "side", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(folder)


def read_texts(spark: SparkSession, folder: str, schema: str, domain: str | None = None) -> DataFrame:
    """What append_texts() wrote; a domain reads its folder alone."""
    got = spark.read.schema(f"{schema}, domain string, side string, batch string").json(folder).drop("batch")
    return got if domain is None else got.where(F.col("domain") == domain)


def still_due(texts: DataFrame, done: DataFrame, key: str = "source_id") -> DataFrame:
    """The rows of texts whose key isn't in done: what a run that stopped has left to do."""
    return texts.join(done.select(key).distinct(), key, "left_anti")


