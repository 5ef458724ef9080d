import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID
from tellscan.functions.questions import QUESTION_BY_ID, QUESTIONS, select_questions
from tellscan.operators.backend import Answer, BackendError, WordBackend, read_answer
from tellscan.operators.calibrate import expected_level, flag_counts, flips, gates
from tellscan.operators.judge import ASKED, _sentence_answers, compare, cost, judge
from tellscan.operators.labels import score_questions, score_rules, totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAS = ["Tom ran. It rained. We left.", "Only one here.", "All is well. And good. So fine."]


class Scripted:
    """Flags what holds a given word; confidence by question."""

    name = "scripted"

    def __init__(self, word="rained", sure=None, drop=None):
        self.word, self.sure, self.drop = word, sure or {}, drop

    def ask(self, state, questions):
        text = state.get("target") or state["paragraph"]
        out = {}
        for n, q in questions.items():
            k = len(q["criteria"])
            bad = self.word in text
            p = [0.8 if i == (0 if bad else k - 1) else 0.2 / (k - 1) for i in range(k)]
            out[n] = Answer("score", p, self.sure.get(n, 0.9), {"input_tokens": 100.0, "note": "x"})
        out.pop(self.drop, None)
        return out


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_triage_and_notes(spark):
    text = "\n\n".join(PARAS)
    notes, usage = judge(docs(spark, text, None, "", "- item"), Scripted(), [QUESTION_BY_ID[i] for i in ("particulars", "wrap-up", "no-news")])
    got = sorted((r.rule, r.line, r.column, r.excerpt, r.confidence) for r in notes.collect())
    assert got == [("no-news", 1, 10, "It rained.", "high"), ("particulars", 1, 1, PARAS[0], "high"), ("wrap-up", 1, 21, "We left.", "high")]
    # two paragraphs of three sentences, three sentences of the flagged one, one of the short one
    assert {r.counter: r.total for r in usage.collect()} == {"requests": 6.0, "input_tokens": 600.0}
    assert cost(usage).first().cost_usd == round(600 * 42e-9, 6)


@pytest.mark.parametrize(("strict", "ids", "requests"), [(True, ("particulars", "no-news"), 9), (False, ("no-news",), 7), (False, (), 0)])
def test_requests(spark, strict, ids, requests):
    _, usage = judge(docs(spark, "\n\n".join(PARAS)), Scripted(), [QUESTION_BY_ID[i] for i in ids], strict=strict)
    assert sum(r.total for r in usage.collect() if r.counter == "requests") == requests


def test_confidence_is_the_lower_and_unsure_flags_go(spark):
    ask = [QUESTION_BY_ID[i] for i in ("no-news", "maxim", "dressed-pair", "names-nothing")]
    sure = {"no-news": 0.6, "maxim": 0.9, "dressed-pair": 0.9, "names-nothing": 0.4}
    for strict, want in ((False, {"no-news": "medium", "maxim": "medium", "dressed-pair": "low"}), (True, {"no-news": "medium", "maxim": "medium", "dressed-pair": "low", "names-nothing": "low"})):
        notes, _ = judge(docs(spark, "It rained."), Scripted(sure=sure), ask, strict=strict)
        assert {r.rule: r.confidence for r in notes.collect()} == want


def test_a_missing_answer_fails_the_job(spark):
    with pytest.raises(Exception, match="no answer for no-news"):
        judge(docs(spark, "It rained."), Scripted(drop="no-news"), [QUESTION_BY_ID["no-news"], QUESTION_BY_ID["maxim"]])[0].collect()


def test_a_tie_flags_nothing(spark):
    class Torn(Scripted):
        def ask(self, state, questions):
            return {n: Answer("score", [0.5, 0.5, 0.0][: len(q["criteria"])], 1.0, {}) for n, q in questions.items()}

    assert judge(docs(spark, "It rained."), Torn(), strict=True)[0].isEmpty()


def test_selection():
    assert len(QUESTIONS) == 20 and len([q for q in QUESTIONS if q.unit == "paragraph"]) == 6
    assert len(select_questions()) == 13 and len(select_questions(strict=True)) == 20
    assert [q.id for q in select_questions(["dressed-pair"])] == ["dressed-pair"]
    with pytest.raises(ValueError):
        select_questions(["nope"])


def test_reading_answers():
    score, noul = {"type": "score", "criteria": [1, 2, 3]}, {"type": "noul"}
    a = read_answer(score, {"probabilities": {"2": 0.7, "0": 0.3}}, {"input_tokens": 5, "note": "x"})
    assert a.probabilities == [0.3, 0.0, 0.7] and a.confidence == pytest.approx(0.4) and a.usage == {"input_tokens": 5.0}
    assert read_answer(noul, {"noul": 0.25}).confidence == 0.5
    assert read_answer(score, {"probabilities": {"1": 1}, "confidence": 0.1}).confidence == 0.1
    for q, raw in ((score, {"probabilities": {}}), (score, {"probabilities": {"3": 1}}), (score, {"probabilities": {"0": "x"}}), (noul, {}), (noul, {"noul": {}})):
        with pytest.raises(BackendError):
            read_answer(q, raw)


def test_compare_maps_the_order_back(spark):
    rows = spark.createDataFrame([(i, "it was so", "On 3 May 1999 Ann Lee left" if i % 5 else "it was so") for i in range(20)] + [(99, None, "X")], "pair_id long, a string, b string")
    got = {r.pair_id: r for r in compare(rows, WordBackend(), drift=True).collect()}
    assert len(got) == 21 and all(got[i].keep == "B" and (got[i].p_keep_b > 0.5 or i % 5 == 0) for i in range(20))
    assert got[0].drift == 0.0 and got[1].drift == 1.0 and got[1].usage["requests"] == 1.0
    other = {r.pair_id: r.p_keep_b for r in compare(rows, WordBackend(), swap=F.col("pair_id") < 10).collect()}
    assert other == {i: pytest.approx(r.p_keep_b) for i, r in got.items()}
    assert got[1].drift is not None and compare(rows, WordBackend()).first().drift is None


LABELS = "id long, sentence string, paragraph string, slop boolean, family string, shape string"


def test_labels(spark):
    para = "It plays a vital role here. Rain fell."
    rows = [(1, "It plays a vital role here.", para, True, "f", None), (2, "Rain fell.", para, True, "f", None), (3, "Rain fell.", para, False, "f", "s"), (4, "It plays a vital role here.", para, False, "g", "s"), (5, "gone", para, True, "g", "s"), (6, None, None, True, "g", "s")]
    labels = spark.createDataFrame(rows, LABELS)
    scored = score_rules(labels, [BY_ID["vital-role"]])
    assert sorted(r.status for r in scored.collect()) == ["FALSE-HIT", "HIT", "MISS", "UNMATCHED", "UNMATCHED", "pass"]
    assert {r.family: tuple(r)[2:] for r in totals(scored).collect()} == {"f": (1, 2, 1, 1), "g": (0, 0, 0, 1)}
    judged = score_questions(labels, Scripted("vital"), [QUESTION_BY_ID[i] for i in ("no-news", "wrap-up", "particulars")], "id")
    got = {(r.rule, r.sentence, r.slop): r.status for r in judged.where("sentence is not null").collect()}
    assert got["no-news", rows[0][1], True] == "HIT" and got["no-news", "Rain fell.", True] == "MISS" and got["no-news", "gone", True] == "UNMATCHED"
    assert got["wrap-up", "Rain fell.", True] == "HIT" and got["wrap-up", rows[0][1], False] == "pass"
    assert got["particulars", "Rain fell.", False] == "FALSE-HIT"


def test_gates(spark):
    rows = spark.createDataFrame([("a", 0.9, i, i if i else -1) for i in range(150)], "g string, c double, x int, y int")
    aucs = spark.createDataFrame([("no-news", 0.4), ("names-nothing", None), ("maxim", 0.9)], "rule string, auc double")
    flipped = flips(rows, "g", "c", "x", "y")
    got = {(r.gate, r.subject): (r.status, r.n) for r in gates(aucs, flipped, flipped.withColumn("agreed", F.col("n") - F.col("flipped"))).collect()}
    assert got == {("auc", "no-news"): ("ok", None), ("auc", "names-nothing"): ("FAIL", None), ("flip", "compare"): ("ok", 150), ("agreement", "check"): ("ok", 150)}
    few = flips(rows.limit(20), "g", "c", "x", "y")
    assert {r.status for r in gates(aucs.limit(0), few, few.withColumn("agreed", F.lit(0))).collect()} == {"n/a", "FAIL"}
    counts = flag_counts(rows.withColumn("f", F.col("x") < 3), ["g"], "f", "c").first()
    assert (counts.n_flagged, counts.n) == (3, 150)
    assert spark.range(1).select(expected_level(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("x")).first().x == pytest.approx(1.3)


def test_answers_are_held_for_a_few_sentences_and_a_paragraph_is_counted_once():
    states = []

    class Kept(WordBackend):
        def ask(self, state, questions):
            states.append((state, got := super().ask(state, questions)))
            return got

    texts = [[f"Row {k} says {i}." for i in range(ASKED // 3)] for k in range(12)] + [[]]
    rows = pa.record_batch({"doc_id": pa.array(range(13)), "sentences": pa.array([[{"asked": t} for t in own] for own in texts])})
    question = QUESTION_BY_ID["no-news"]
    parts = list(_sentence_answers(Kept(), {question.id: question.asked("x")}, "x")(iter([rows, rows.slice(5)])))
    assert max(sum(map(len, p.column("sentences").to_pylist())) for p in parts) < 2 * ASKED and len(parts) > 3
    back = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in back] == [*range(13), *range(5, 13)] and all(len(r["requests"]) == len(r["sentences"]) for r in back)
    assert len({id(s["paragraph"]) for s, _ in states}) == 19
    assert all(got["no-news"].usage == {"input_tokens": sum(len(str(v)) for v in s.values()) // 4} for s, got in states[:: ASKED // 5])


def test_no_paragraph_goes_with_each_note(spark):
    text = "Tom ran 3 miles. " * 5 + "\n\nIt rained.\nWe left."
    notes = judge(docs(spark, text), Scripted(), [QUESTION_BY_ID[i] for i in ("particulars", "no-news")], strict=True)[0]
    assert "written" not in notes._jdf.queryExecution().toString()
    assert [(r.line, r.column, r.context) for r in notes.collect()] == [(3, 1, "…Tom ran 3 miles. Tom ran 3 miles. It rained. We left.")]


def test_labels_run_a_pattern_only_where_its_words_are(spark):
    rows = [(1, "It plays a vital role.", "So. It plays a vital role.", True, "f", None), (2, "Rain fell.", "Rain fell.", True, "f", None)]
    scored = score_rules(spark.createDataFrame(rows, LABELS), [BY_ID["vital-role"]])
    assert "contains(low" in scored._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(r.status for r in scored.collect()) == ["HIT", "MISS"]


def test_only_what_was_noted_is_kept_and_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr("tellscan.operators.judge.settle", lambda df: kept.append(df.schema) or df)
    ids = ("particulars", "throat-clearing", "wrap-up", "no-news", "maxim")
    for strict in (True, False):
        notes, usage = judge(docs(spark, "\n\n".join(PARAS), None, "It rained."), Scripted(sure={"maxim": 0.6}), [QUESTION_BY_ID[i] for i in ids], strict=strict)
        got = sorted((r.doc_id, r.rule, r.ord, r.excerpt, r.confidence) for r in notes.collect())
        of_paragraph = [(0, "particulars", 0, PARAS[0], "high"), (0, "throat-clearing", 1, "Tom ran.", "high"), (0, "wrap-up", 2, "We left.", "high")]
        assert got == sorted([*of_paragraph, *[(d, rule, i, "It rained.", sure) for d in (0, 2) for rule, i, sure in (("no-news", 3, "high"), ("maxim", 4, "medium"))]])
        requests = 2 + 8 if strict else 2 + 5
        assert {r.counter: r.total for r in usage.collect()} == {"requests": float(requests), "input_tokens": 100.0 * requests}
    # answers and sentences that nothing is noted of would be written and read again, many times the text
    assert len(kept) == 2 and all(s.names == ["doc_id", "noted", "usages"] and "probabilities" not in s.simpleString() for s in kept)
