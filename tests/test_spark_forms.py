"""Joins of intervals, answers that stay, sinks that can be repeated, rates over a stream, records of a CSV."""

import csv
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID
from tellscan.operators.backend import BackendError, WordBackend
from tellscan.operators.corpus import append_texts, chosen, common, lacking, read_texts, units
from tellscan.operators.intervals import overlapping
from tellscan.operators.judge import judge
from tellscan.sources.texts import csv_records, csv_with_header
from tellscan.streaming.rates import SCHEMA, rate_folder, rates


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    span = lambda: (s := rng.randrange(300), s + rng.choice([0, 1, 5, 40, 200]))
    left = [(rng.choice([1, 1, 1, 2, None]), *span(), i) for i in range(300)] + [(1, 5, None, -1), (1, 7, 9, -2), (1, 7, 9, -2)]
    right = [(rng.choice([1, 1, 2, 3]), *span(), i) for i in range(200)]
    a, b = spark.createDataFrame(left, "doc_id long, start long, end long, l int"), spark.createDataFrame(right, "doc_id long, `from` long, `to` long, r int")
    want = sorted((x[0], x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[2] is not None and x[1] < y[2] and x[2] > y[1] and x[1] < x[2] and y[1] < y[2])
    for bucket in (16, 4096):
        assert sorted((r.doc_id, r.l, r.r) for r in overlapping(a, b, bucket=bucket).collect()) == want
    assert overlapping(a.limit(0), b).count() == 0 and len(want) > 1000


def test_a_stopped_run_asks_only_what_is_left(spark, tmp_path):
    class Counting(WordBackend):
        """Writes down what it is asked, and breaks on one text until told not to."""

        def __init__(self, log, broken):
            super().__init__()
            object.__setattr__(self, "log", log)
            object.__setattr__(self, "broken", broken)

        def ask(self, state, questions):
            with open(self.log, "a") as f:
                f.write("x\n")
            if self.broken and "Ninth" in str(state):
                raise BackendError("gone")
            return super().ask(state, questions)

    log, store = str(tmp_path / "log"), f"file://{tmp_path / 'answers'}"
    n = lambda: len(open(log).readlines())
    names = ["First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth"]
    rows = [(i, f"{w} came the rain. It fell on Leeds for 9 days. They left.") for i, w in enumerate(names)] + [(100, "First came the rain. It fell on Leeds for 9 days. They left.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(Exception, match="gone"):
        judge(docs, Counting(log, True), store=store)[0].count()
    asked = n()
    notes = judge(docs, Counting(log, False), store=store, strict=False)[0]
    got = sorted(map(str, notes.collect()))
    assert 0 < n() - asked < n() and got == sorted(map(str, judge(docs, WordBackend())[0].collect()))
    done = n()
    assert judge(docs, Counting(log, True), store=store)[1].where("counter = 'requests'").first().total == judge(docs, WordBackend())[1].where("counter = 'requests'").first().total
    assert n() == done  # all is there; the text that stands twice was asked about once
    assert judge(spark.createDataFrame(rows[:1], docs.schema), Counting(log, False), store=store, register="a baker")[0].count() >= 0 and n() > done


def test_the_same_batch_twice_is_there_once(spark, tmp_path):
    schema = "source_id long, text string"
    rows = spark.createDataFrame([(1, "a", "news", "human"), (2, "b", "news", "model"), (3, "c", "blogs", "human")], f"{schema}, domain string, side string")
    folder = str(tmp_path / "texts")
    for _ in range(2):
        append_texts(rows, folder)
    append_texts(rows.where("source_id = 1"), folder, "again")
    append_texts(rows.where("source_id = 1").repartition(2), folder, "again")
    assert sorted(r.source_id for r in read_texts(spark, folder, schema).collect()) == [1, 1, 2, 3]


def test_rates_over_a_stream_equal_the_table(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 5, 1, h, m)
    text = "It plays a vital role here. " * 3
    parts = [[(1, "a", text, at(1)), (2, "b", "Plain words.", at(1, 30)), (1, "a", text, at(1))], [(3, "a", text, at(2)), (1, "a", text, at(1, 5)), (4, None, None, at(2)), (9, "a", text, None)], [(5, "a", "The end.", at(9))], [(8, "b", "More.", at(9))], [(6, "a", text, at(1))], [(7, "a", "Last.", at(20))]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = [BY_ID["vital-role"]]
    for _ in range(2):
        rate_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), rules, files=1).awaitTermination()
    got = {(r.start, r.source): (r.n_docs, r.words, r.notes, r.per_1k) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    on_time = spark.createDataFrame([r for rows in parts for r in rows if r[0] != 6], SCHEMA)
    want = {(r.start, r.source): (r.n_docs, r.words, r.notes, r.per_1k) for r in rates(on_time, rules).where(F.col("start") < F.lit(at(18))).collect()}
    assert got == want and want[(at(1), "a")] == (1, 18, 3, round(3000 / 18, 6))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_equal_those_of_one_task(spark, tmp_path, end):
    rng = random.Random(5)
    field = lambda: "".join(rng.choice(["a", "é", '"', ",", "\n", " b", "x"]) for _ in range(rng.randrange(1, 12))).strip() or "z"
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "text", "more"])
            out.writerows([1000 * k + i, field(), rng.choice([field(), ""])] for i in range(400))
    schema = "id long, text string, more string"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = csv_records(spark, str(tmp_path), schema)
        got = sorted(map(tuple, rows.collect()), key=repr)
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(tuple, csv_with_header(spark, str(tmp_path), schema).collect()), key=repr) and len(got) == 1200


def test_filters_and_sets_of_rows(spark):
    rows = spark.createDataFrame([("greedy", "f", 1), ("greedy", None, 2), ("sampled", "g", 2), ("sampled", "g", 2)], "decoding string, family string, shape int")
    assert chosen(rows, decoding="greedy", family=None).count() == 2 and chosen(rows, family=["f", "g"], shape="2").count() == 2
    with pytest.raises(ValueError, match="side"):
        chosen(rows, side="human")
    two = rows.where("shape = 2")
    assert sorted(map(str, common(rows, two, "family").collect())) == ["Row(family='g')", "Row(family=None)"]
    assert lacking(two, two.limit(1), "decoding", "family").count() == 2 and lacking(rows, rows, "shape").isEmpty()


def test_first_paragraphs_are_limited_before_they_meet(spark):
    text = "\n\n".join(f"One {k}. Two. Three." for k in range(5))
    found = units(spark.createDataFrame([(1, text), (2, "Short."), (3, None)], "text_id long, text string"))
    assert sorted((r.text_id, r.place, r.asked) for r in found.collect()) == [(1, 0, "One 0. Two. Three."), (1, 1, "One 1. Two. Three.")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan
