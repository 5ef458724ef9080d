"""python -m tellscan: check and compare texts, list and explain rules. 0: nothing found, 1: notes, 2: a wrong call, 3: a failed backend."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellscan import __version__
from tellscan.functions.catalog import RULES, explain, explained, rules_table, select_rules
from tellscan.functions.questions import QUESTIONS
from tellscan.operators.backend import BackendError, HttpBackend
from tellscan.operators.check import FAILED, WRONG, checked, unreadable, usage_line, usage_report
from tellscan.operators.corpus import chosen, first_notes, rates
from tellscan.operators.judge import compare
from tellscan.operators.labels import score_rules, totals
from tellscan.operators.scan import NOTE_FIELDS
from tellscan.sources.texts import json_lines, one_text, whole_files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tellscan")
    of = top.add_subparsers(dest="command", required=True)
    check = of.add_parser("check", help="notes of texts; - is standard input")
    check.add_argument("paths", nargs="*", default=["-"])
    check.add_argument("--select", action="append")
    check.add_argument("--ignore", action="append")
    check.add_argument("--strict", action="store_true")
    check.add_argument("--markdown", action="store_true")
    check.add_argument("--json", action="store_true")
    check.add_argument("--backend", metavar="URL")
    check.add_argument("--model", default="")
    check.add_argument("--register")
    listed = of.add_parser("rules", help="the pattern rules and the questions")
    listed.add_argument("--json", action="store_true")
    of.add_parser("explain").add_argument("rule")
    pair = of.add_parser("compare", help="which of two texts a careful editor would print")
    pair.add_argument("a")
    pair.add_argument("b")
    pair.add_argument("--backend", metavar="URL", required=True)
    pair.add_argument("--model", default="")
    pair.add_argument("--drift", action="store_true", help="ask also whether B says something else than A")
    pair.add_argument("--json", action="store_true")
    rated = of.add_parser("rates", help="notes for each thousand words by domain and side, from lines of JSON: source_id, domain, side, text")
    rated.add_argument("path")
    rated.add_argument("--first", type=int, default=0, metavar="N", help="also the first N notes of each rule in human texts")
    rated.add_argument("--json", action="store_true")
    labels = of.add_parser("labels", help="rules against labelled sentences, from lines of JSON: sentence, paragraph, slop, family, shape")
    labels.add_argument("path")
    labels.add_argument("--family")
    labels.add_argument("--shape")
    labels.add_argument("--json", action="store_true")
    of.add_parser("version")
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        options = _parser().parse_args(argv)
    except SystemExit as e:
        return WRONG if e.code else 0
    if options.command == "version":
        print(__version__)
        return 0
    if options.command == "rules":
        rules = [{f: getattr(r, f) for f in ("id", "category", "severity", "confidence", "message", "suggestion")} for r in RULES]
        asked = [{f: getattr(q, f) for f in ("id", "category", "unit", "severity", "confidence", "message", "suggestion")} for q in QUESTIONS]
        print(json.dumps([*rules, *asked], indent=2) if options.json else "\n".join([rules_table(), *(f"{q.id:<34} {q.severity:<8} {q.confidence:<7} asked of each {q.unit}" for q in QUESTIONS)]))
        return 0
    if options.command == "explain":
        try:
            explain(options.rule)
        except ValueError as e:
            print(e, file=sys.stderr)
            return WRONG
        print(explained(options.rule))
        return 0
    spark = SparkSession.builder.getOrCreate()
    return {"check": _check, "compare": _compare, "rates": _rates, "labels": _labels}[options.command](spark, options)


def _show(tables: dict[str, DataFrame], as_json: bool) -> None:
    """Prints reports of a few rows each: by rule, domain and side, never by text."""
    rows = {name: [r.asDict() for r in t.orderBy(*t.columns[:3]).collect()] for name, t in tables.items()}
    if as_json:
        print(json.dumps(rows, ensure_ascii=False))
        return
    for name, t in tables.items():
        print("\t".join(t.columns))
        for r in rows[name]:
            print("\t".join("" if v is None else str(v) for v in r.values()))
        print()


def _rates(spark: SparkSession, options: argparse.Namespace) -> int:
    try:
        texts = json_lines(spark, options.path, "source_id string, domain string, side string, text string")
        _show({"rates": rates(texts)} | ({"first": first_notes(texts, options.first)} if options.first > 0 else {}), options.json)
    except PySparkException as e:
        print(unreadable(e) or e, file=sys.stderr)
        return WRONG
    return 0


def _labels(spark: SparkSession, options: argparse.Namespace) -> int:
    try:
        rows = chosen(json_lines(spark, options.path, "sentence string, paragraph string, slop boolean, family string, shape string"), family=options.family, shape=options.shape)
        if rows.isEmpty():
            raise ValueError(f"no labels for family {options.family} and shape {options.shape} in {options.path}")
        _show({"totals": totals(score_rules(rows, select_rules()))}, options.json)
    except (ValueError, PySparkException) as e:
        print(unreadable(e) or e, file=sys.stderr)
        return WRONG
    return 0


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = [p for p in paths if p != "-"]
    docs = one_text(spark, sys.stdin.buffer.read()) if "-" in paths else None
    if files:
        docs = whole_files(spark, files) if docs is None else docs.unionByName(whole_files(spark, files))
    return docs


def _check(spark: SparkSession, options: argparse.Namespace) -> int:
    try:
        docs = _read(spark, options.paths)
        backend = HttpBackend(options.backend, options.model) if options.backend else None
    except (ValueError, PySparkException) as e:
        print(unreadable(e) or e, file=sys.stderr)
        return WRONG
    status, rows, usage, said = checked(docs, select=options.select, ignore=options.ignore, strict=options.strict, markdown=options.markdown, backend=backend, register=options.register)
    if said:
        print(said, file=sys.stderr)
    elif usage is not None:
        print(usage_line(usage), file=sys.stderr)
    low = sum(r.confidence == "low" for r in rows)
    if options.strict and low:
        print(f"{low} of {len(rows)} notes are of low confidence: they need an eye", file=sys.stderr)
    found = [{"path": r.path, **{f: r[f] for f in NOTE_FIELDS if f != "count" or r[f] is not None}} for r in rows]
    if options.json and status != WRONG:
        notes = {p: [n for n in found if n["path"] == p] for p in dict.fromkeys(n["path"] for n in found)} if len([p for p in options.paths if p != "-"]) > 1 else found
        print(json.dumps(notes if usage is None else {"notes": notes, "judge": usage_report(usage, options.backend)}, ensure_ascii=False))
    elif not options.json:
        for n in found:
            print(f"{n['path']}:{n['line']}:{n['column']}: {n['severity']} ({n['confidence']} confidence) {n['rule']}  {n['message']}\n    {n['context']}\n    fix: {n['suggestion']}\n")
    return status


def _compare(spark: SparkSession, options: argparse.Namespace) -> int:
    """Prints which of two texts is kept, and how surely; status 0 whichever it is."""
    try:
        a, b = (one_text(spark, _bytes(p), p) for p in (options.a, options.b))
        pair = a.select(F.lit("pair").alias("pair_id"), F.col("text").alias("a")).crossJoin(b.select(F.col("text").alias("b")))  # one row and one row
        if not pair.where(r"a rlike '\\S' and b rlike '\\S'").count():
            raise ValueError("one of the texts is empty")
        row = compare(pair, HttpBackend(options.backend, options.model), drift=options.drift).first()
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return WRONG
    except (BackendError, PySparkException) as e:
        print(f"backend failure: {e}", file=sys.stderr)
        return FAILED
    got = {k: v for k, v in row.asDict(recursive=True).items() if k != "pair_id" and v is not None}
    print(json.dumps(got, ensure_ascii=False) if options.json else "\n".join(f"{k}: {v}" for k, v in got.items()))
    return 0


def _bytes(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


if __name__ == "__main__":
    sys.exit(main())
