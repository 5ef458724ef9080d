import itertools
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tellscan.__main__ import main
from tellscan.functions.catalog import BY_ID, explain, explained, rules_table
from tellscan.functions.questions import QUESTIONS
from tellscan.operators.backend import Answer, BackendError, HttpBackend, WordBackend, each
from tellscan.operators.check import CLEAN, FAILED, FOUND, WRONG, UsageError, check, run_check, selected, usage_line
from tellscan.operators.corpus import append_texts, both_orders, calibration, flagged_units, pairs_of, rank_auc, read_texts, sampled, scored, still_due, units
from tellscan.operators.report import by_category
from tellscan.operators.scan import scan
from tellscan.sources.texts import one_text

TEXT = "The valley is a rich tapestry. It plays a vital role here.\n\nit rained. it rained on. it went on."


def texts(spark, *rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_notes_of_both_kinds_come_in_order(spark):
    docs = texts(spark, ("b.txt", TEXT), ("a.txt", TEXT), ("c.txt", None))
    checked = check(docs, backend=WordBackend(), register="a baker", order=spark.createDataFrame([("b.txt", 0), ("a.txt", 1), ("c.txt", 2)], "path string, place int"))
    rows = checked.ordered().collect()
    assert [p for p, _ in itertools.groupby(r.path for r in rows)] == ["b.txt", "a.txt"] and checked.status() == FOUND
    assert {0, 1} == {r.kind for r in rows}
    for _, group in itertools.groupby(rows, lambda r: r.path):
        places = [(r.line, r.column, r.kind, r.ord) for r in group]
        assert places == sorted(places)
    assert usage_line(checked.usage).startswith("6 requests, ") and usage_line(checked.usage).endswith("01") is False


def test_statuses(spark):
    class Broken(WordBackend):
        def ask(self, state, questions):
            raise BackendError("gone")

    docs = texts(spark, ("a", TEXT))
    assert run_check(docs)[0] == FOUND and run_check(texts(spark, ("a", "It rained.")))[::2] == (CLEAN, "")
    assert run_check(docs, register="a baker") == (WRONG, [], "a register needs a backend: without one nobody is asked anything")
    assert run_check(docs, select=["maxim"])[0] == WRONG and run_check(texts(spark, ("a", " \n"), ("b", None)))[0] == WRONG
    status, rows, said = run_check(docs, backend=Broken())
    assert (status, rows) == (FAILED, []) and "gone" in said
    assert run_check(docs, backend=Broken(), select=["em-dash"])[0] == CLEAN  # nothing to ask


def test_selection_over_both_catalogues():
    rules, questions = selected(["maxim", "puffery"], ["vital-role"], False, True)
    assert [q.id for q in questions] == ["maxim"] and {r.category for r in rules} == {"puffery"} and "vital-role" not in {r.id for r in rules}
    assert selected(["maxim"], None, False, True)[0] == [] and selected(["puffery"], None, False, True)[1] == []
    with pytest.raises(UsageError, match="maxim"):
        selected(["maxim"], None, False, False)


def test_listing_and_explaining(capsys):
    assert len(rules_table().split("\n")) == len(BY_ID) == 84
    assert explain("no-x-no-y")["noted"] and explain("maxim")["levels"] and "noted:\n    " in explained("em-dash")
    assert main(["rules", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 104
    assert main(["explain", "vital-role"]) == 0 and main(["explain", "nope"]) == WRONG and main(["chekc"]) == WRONG


def test_the_command_reads_files(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_bytes(b"\xff")
    assert main(["check", "--json", "--select", "vital-role", str(tmp_path / "a.txt")]) == FOUND
    found = json.loads(capsys.readouterr().out)
    assert [(n["rule"], n["line"], n["column"]) for n in found] == [("vital-role", 1, 35)] and "count" not in found[0]
    assert main(["check", "--register", "x", str(tmp_path / "a.txt")]) == WRONG
    with pytest.raises(ValueError, match="UTF-8"):
        one_text(spark, b"\xff")


def test_categories(spark):
    got = {r.category: (r.n_rules, r.n_notes) for r in by_category(scan(texts(spark, ("a", TEXT), ("b", TEXT)), [BY_ID[i] for i in ("vital-role", "rich-tapestry", "em-dash")], key="path")).collect()}
    assert got == {"puffery": (2, 4)}


def test_requests_run_side_by_side_and_in_order():
    inside, most, lock = 0, 0, threading.Lock()

    def job(n):
        nonlocal inside, most
        with lock:
            inside, most = inside + 1, max(most, inside + 1)
        threading.Event().wait(0.02)
        with lock:
            inside -= 1
        if n == 99:
            raise BackendError("gone")
        return n * n

    backend = HttpBackend("https://localhost:1", "m", parallel=4)
    assert each(backend, range(12), job) == [n * n for n in range(12)] and 1 < most <= 4
    with pytest.raises(BackendError):
        each(backend, [99, *range(20)], job)


def test_a_busy_service_is_asked_again():
    class Service(BaseHTTPRequestHandler):
        codes = [503, 429, 200]
        seen: list = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.seen.append((self.headers["Authorization"], body["model"], self.path))
            self.send_response(code := self.codes.pop(0))
            if code == 302:
                self.send_header("Location", "/other")
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"answers": {"x": {"probabilities": {"0": 0.9, "1": 0.1}}}, "usage": {"input_tokens": 3}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = {"x": {"type": "score", "criteria": [1, 2]}}
    backend = HttpBackend(f"http://127.0.0.1:{server.server_port}/ask", "m", "k", wait=0.0)
    got = backend.ask({}, asked)["x"]
    assert got == Answer("score", [0.9, 0.1], pytest.approx(0.8), {"input_tokens": 3.0}) and Service.seen == [("Bearer k", "m", "/ask")] * 3
    for codes in ([400], [302], [500] * 6):
        Service.codes, Service.seen = list(codes), []
        with pytest.raises(BackendError):
            backend.ask({}, asked)
        assert len(Service.codes) == 0
    server.shutdown()
    for url in ("http://example.org", "ftp://x", "https://", "https://me@x"):
        with pytest.raises(ValueError):
            HttpBackend(url, "m")


def test_calibration_on_a_small_corpus(spark):
    plain, dressed = "On 3 May 1999 Ann Lee left Rome. It rained. She took 2 bags.", " ".join(["It " + "was so and " * 12 + "so."] * 3)
    rows = [(f"{s}{i}", i, s, "news", plain if s == "human" else dressed) for i in range(4) for s in ("human", "m1")] + [("x", 99, "m1", "news", plain), ("y", None, "human", "news", plain)]
    corpus = spark.createDataFrame(rows, "text_id string, source_id long, side string, register string, text string")
    some = sampled(corpus, 3)
    assert {(r.source_id, r.side) for r in some.collect()} == {(i, s) for i in range(3) for s in ("human", "m1")}
    parts = units(corpus.where("text_id in ('human0', 'm10')")).collect()
    assert [(p.text_id, p.place, len(p.sentences)) for p in sorted(parts)] == [("human0", 0, 3), ("m10", 0, 3)]
    placed = units(some).join(some.select("text_id", "source_id", "side", "register"), "text_id")
    scores = scored(placed.select("source_id", "side", "register", "asked"), WordBackend(), WordBackend(), QUESTIONS)
    assert {r.rule for r in scores.collect()} == {q.id for q in QUESTIONS if q.unit == "paragraph"}
    assert all(r.auc == 0.0 and (r.n_pos, r.n_neg) == (3, 3) for r in rank_auc(scores).collect())
    assert {(r.side, r.flagged) for r in scores.where("rule = 'particulars'").collect()} == {("human", False), ("m1", True)}
    sure = flagged_units(scores.withColumn("confidence", F.lit(0.5))).where("rule = 'particulars'").collect()
    assert {r.side: (r.n_flagged, r.n) for r in sure} == {"human": (0, 3), "m1": (3, 3)}
    pairs = pairs_of(placed.select("source_id", "side", "register", "asked"))
    turned = both_orders(pairs, WordBackend())
    assert {tuple(r)[1:4] for r in turned.collect()} == {("m1", "A", "A")} and turned.count() == 3
    one_sided = both_orders(pairs, WordBackend(favour=0.4)).collect()
    assert all(r.keep != r.keep_again for r in one_sided)
    lines = {(r.gate, r.subject): r.status for r in calibration(scores, turned, "m1", "news").collect()}
    assert lines == {("flip", "compare"): "n/a", ("agreement", "check"): "ok"}


def test_texts_by_domain_and_side_and_what_is_due(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "news", "human"), (2, "b", "news", "m1"), (3, "c", "blogs", "human")], "source_id long, text string, domain string, side string")
    folder = str(tmp_path / "corpus")
    append_texts(rows.where("source_id < 3"), folder)
    schema = "source_id long, text string"
    due = still_due(rows, read_texts(spark, folder, schema))
    assert [r.source_id for r in due.collect()] == [3]
    append_texts(due, folder)
    assert read_texts(spark, folder, schema).count() == 3 and [r.text for r in read_texts(spark, folder, schema, "blogs").collect()] == ["c"]
    assert "PartitionFilters: [isnotnull(domain" in read_texts(spark, folder, schema, "blogs")._jdf.queryExecution().executedPlan().toString()
    assert read_texts(spark, folder, schema).where(F.col("side") == "human").count() == 2


def test_texts_that_cannot_be_read_are_a_wrong_call(spark, tmp_path, capsys):
    (tmp_path / "bad.txt").write_bytes(b"plays a vital role \xff\xfe")
    (tmp_path / "good.txt").write_text("It plays a vital role.")
    for paths in (["gone.txt"], ["bad.txt"], ["good.txt", "bad.txt"], ["good.txt", "gone.txt"]):
        assert main(["check", *(str(tmp_path / p) for p in paths)]) == WRONG
        out = capsys.readouterr()
        assert not out.out and len(out.err.strip().splitlines()) == 1 and paths[-1] in out.err and "Exception" not in out.err


def test_low_notes_are_counted_under_strict(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("It is genuinely odd.")
    assert main(["check", "--strict", "--select", "genuinely", str(tmp_path / "a.txt")]) == FOUND
    assert "1 of 1 notes are of low confidence" in capsys.readouterr().err


def test_version_and_listing_of_questions(capsys):
    import tellscan

    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == tellscan.__version__
    assert main(["rules"]) == 0 and "maxim" in capsys.readouterr().out


def test_compare_and_usage_as_commands(spark, tmp_path, capsys, monkeypatch):
    import tellscan.__main__ as command

    class Broken(WordBackend):
        def ask(self, state, questions):
            raise BackendError("gone")

    monkeypatch.setattr(command, "HttpBackend", lambda url, model: Broken() if url == "broken" else WordBackend())
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("It was cold. They left. No one spoke.")
    b.write_text("On 3 May 1931 Ada Byrd left Leeds. She was 41. Her train left at 9.")
    assert main(["compare", str(a), str(b), "--backend", "http://x", "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["keep"] == "B" and 0.5 <= got["p_keep_b"] <= 1
    assert main(["compare", str(a), str(b), "--backend", "http://x", "--drift"]) == 0 and "drift:" in capsys.readouterr().out
    assert main(["compare", str(a), str(tmp_path / "gone"), "--backend", "http://x"]) == WRONG
    assert main(["compare", str(a), str(b), "--backend", "broken"]) == FAILED
    capsys.readouterr()
    assert main(["check", "--json", "--backend", "http://x", "--select", "maxim", str(a)]) in (CLEAN, FOUND)
    judged = json.loads(capsys.readouterr().out)
    assert judged["judge"]["requests"] > 0 and judged["judge"]["backend"] == "http://x" and isinstance(judged["notes"], list)
    a.write_text("# Only a heading\n")
    assert main(["check", "--backend", "http://x", "--select", "maxim", str(a)]) == WRONG and "not asked" in capsys.readouterr().err


def test_reports_as_commands(spark, tmp_path, capsys):
    texts = [{"source_id": "1", "domain": "news", "side": "human", "text": "It plays a vital role. Here it plays a vital role."}, {"source_id": "1", "domain": "news", "side": "model", "text": "Plain words."}, {"source_id": "2", "domain": "blogs", "side": "human", "text": None}]
    (tmp_path / "texts.jsonl").write_text("\n".join(map(json.dumps, texts)))
    assert main(["rates", str(tmp_path / "texts.jsonl"), "--first", "1", "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert {(r["domain"], r["side"]): (r["n_texts"], r["words"], r["notes"], r["per_1k"]) for r in got["rates"]} == {("news", "human"): (1, 11, 2, 181.818182), ("news", "model"): (1, 2, 0, 0.0), ("blogs", "human"): (1, 0, 0, 0.0)}
    assert [(r["rule"], r["place"], r["line"], r["column"]) for r in got["first"]] == [("vital-role", 1, 1, 4)]
    labels = [{"sentence": "It plays a vital role.", "paragraph": "So. It plays a vital role.", "slop": True, "family": "a"}, {"sentence": "So.", "paragraph": "So. It plays a vital role.", "slop": False, "family": "b", "shape": "x"}]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, labels)))
    assert main(["labels", str(tmp_path / "labels.jsonl"), "--family", "a", "--json"]) == 0
    totals = {(r["rule"], r["family"]): (r["slop_hit"], r["slop_all"]) for r in json.loads(capsys.readouterr().out)["totals"]}
    assert totals[("vital-role", "a")] == (1, 1) and not any(f == "b" for _, f in totals)
    assert main(["labels", str(tmp_path / "labels.jsonl")]) == 0 and "vital-role" in capsys.readouterr().out
    assert main(["labels", str(tmp_path / "labels.jsonl"), "--shape", "y"]) == WRONG and main(["rates", str(tmp_path / "gone")]) == WRONG
