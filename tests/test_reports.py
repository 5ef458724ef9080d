import json

import random

import pytest
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID
from tellscan.functions.examples import CASES
from tellscan.operators.calibrate import agreement, auc
from tellscan.operators.report import as_text, json_by_document, low_notes
from tellscan.operators.scan import scan
from tellscan.operators.split import split
from tellscan.plans.queries import notes_as_json
from tellscan.sources.texts import by_prefix, csv_with_header, json_lines, require_text, whole_files
from tellscan.streaming.scan import scan_folder


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_paragraphs_and_sentences(spark):
    text = "  Dr. Ito came. “Late!” She left\nat 5. \n \nünë 😀 e.g. This. 1. First item.\r\n\r\n\n\nU.S. Trade fell? Yes."
    rows = split(docs(spark, text, None, " \n\n ")).orderBy("doc_id", "paragraph").collect()
    assert {r.doc_id for r in rows} == {0} and len(rows) == 3
    assert [[s.text for s in r.sentences] for r in rows] == [["Dr. Ito came.", "“Late!”", "She left at 5."], ["ünë 😀 e.g. This.", "1. First item."], ["U.S. Trade fell?", "Yes."]]
    for r in rows:
        for s in r.sentences:
            assert " ".join(text[s.offset : s.offset + s.length].split()) == s.text


def test_reports(spark):
    notes = scan(docs(spark, "It is rich tapestry.\nA genuinely cold — day.", "plain", None), [BY_ID[i] for i in ("em-dash", "genuinely", "rich-tapestry")])
    got = json_by_document(notes).collect()
    assert len(got) == 1
    found = json.loads(got[0].json)
    assert [(n["rule"], n["line"]) for n in found] == [("rich-tapestry", 1), ("genuinely", 2), ("em-dash", 2)] and "count" not in found[0]
    first = as_text(notes).orderBy("line", "column").first().report.split("\n")
    assert first[0].startswith("0:1:7: error (high confidence) rich-tapestry  ") and [x[:10] for x in first[1:]] == ["    excerp", "    why: P", "    fix: N"]
    assert low_notes(notes).first().n == 1


def test_auc_and_agreement(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 2, True), ("a", 3, True), ("a", None, True), ("b", 1, True)]
    got = {r.g: r for r in auc(spark.createDataFrame(rows, "g string, s int, p boolean"), "g", "s", "p").collect()}
    assert got["a"].auc == 0.5 and got["a"].n_pos == 3 and got["b"].auc is None
    rows = [("a", 0.9, 1, 1), ("a", 0.6, 1, 0), ("a", 0.1, None, None)]
    got = {r.floor: (r.n, r.agreed) for r in agreement(spark.createDataFrame(rows, "g string, c double, x int, y int"), "g", "c", "x", "y").collect()}
    assert got == {0.7: (1, 1), 0.5: (2, 1), 0.0: (3, 2)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ünë\ntwo")
    assert whole_files(spark, str(tmp_path / "a.txt")).first().text == "ünë\ntwo"
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception, match="UTF-8"):
        whole_files(spark, str(tmp_path / "b.txt")).collect()
    with pytest.raises(ValueError):
        require_text(docs(spark, " ", None, "\n"))
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "x"}\n')
    assert json_lines(spark, str(tmp_path / "c.jsonl"), "id long, text string").first().text == "x"
    (tmp_path / "d.csv").write_text('id,text\n1,"a ""b""\nc"\n')
    assert csv_with_header(spark, str(tmp_path / "d.csv"), "id long, text string").first().text == 'a "b"\nc'
    spark.createDataFrame([("blog_1", "x"), ("news_1", "y")], "doc_id string, text string").write.parquet(str(tmp_path / "e"))
    assert [r.doc_id for r in by_prefix(spark, str(tmp_path / "e"), "blog_").collect()] == ["blog_1"]


def test_stream_reads_each_file_once(spark, tmp_path):
    a, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for text in ("a rich tapestry", "a tapestry of x"):
        docs(spark, text).coalesce(1).write.mode("append").parquet(a)
        scan_folder(spark, a, out, state, [BY_ID["rich-tapestry"]]).awaitTermination()
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 2


def test_json_query_has_the_guarded_rules(spark, tmp_path):
    cases = [(i, rule, CASES[rule][0]) for i, rule in enumerate(r for r in CASES if BY_ID[r].confidence != "low")]
    docs = spark.createDataFrame([(i, text, "en", "s") for i, _, text in cases], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.json for r in notes_as_json(spark, str(tmp_path)).collect()}
    assert [rule for i, rule, _ in cases if f'"{rule}"' not in got.get(i, "")] == []
    assert not any(f'"{r.id}"' in j for r in BY_ID.values() if r.confidence == "low" for j in got.values())


def test_auc_by_ranges_equals_all_pairs(spark):
    """Many scores and few, ties, a null group and null scores; and no window of a plan is over a group alone but that over its ranges."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([round(rng.random(), 3), 0.5, None]), rng.choice([True, False, False, None])) for _ in range(3000)] + [("one", 1.0, True)]
    found = auc(spark.createDataFrame(rows, "g string, s double, p boolean"), "g", "s", "p")
    for r in found.collect():
        pos, neg = ([s for g, s, p in rows if g == r.g and s is not None and p is side] for side in (True, False))
        won = sum((x > y) + (x == y) / 2 for x in pos for y in neg)
        assert (r.n_pos, r.n_neg) == (len(pos), len(neg)) and (r.auc == pytest.approx(won / (len(pos) * len(neg))) if pos and neg else r.auc is None)
    assert found.count() == 4


def test_first_rows_are_limited_before_they_meet(spark):
    from tellscan.plans.queries import QUERIES

    for name in ("first_hits", "first_notes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2 and "collect_list" not in plan


def test_no_text_goes_into_the_join_with_labels(spark):
    from tellscan.plans.queries import QUERIES

    for name in ("first_hits", "first_notes", "notes_per_1k_words", "quality_auc"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert name == "quality_auc" or joins
