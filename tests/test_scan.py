import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID, RULES, select_rules
from tellscan.operators.scan import blank_markdown, context_window, counts, scan, spans
from tellscan.operators.table import BLOCK, block_table, cut, place


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_catalog_is_sound():
    assert len(BY_ID) == len(RULES)
    assert not any("[[:" in r.regex or "\\K" in r.regex or "(?x" in r.regex for r in RULES)


def test_positions_count_and_context(spark):
    text = "Ünë 😀 line\nwith no bread, no milk, no eggs at all on this long second line of the text"
    note = scan(docs(spark, text, None, ""), [BY_ID["no-x-no-y"]]).collect()
    assert len(note) == 1
    n = note[0]
    off = text.index("no bread")
    assert (n.line, n.column, n["count"]) == (2, off - text.index("\n"), 3)
    assert n.excerpt == "no bread, no milk, no eggs" and n.message == "A chain of 3 negated items."
    assert n.context.startswith("Ünë 😀 line with no bread") and n.context.endswith("…")


def test_skip_and_selection(spark):
    assert scan(docs(spark, "There is not nothing. They are not nothing."), [BY_ID["not-nothing"]]).count() == 0
    assert scan(docs(spark, "It's not nothing."), [BY_ID["not-nothing"]]).count() == 1
    assert "genuinely" not in {r.id for r in select_rules()}
    assert [r.id for r in select_rules(["genuinely"])] == ["genuinely"]
    assert {r.category for r in select_rules(["puffery"], strict=True)} == {"puffery"}
    assert "em-dash" not in {r.id for r in select_rules(ignore=["punctuation"])}
    with pytest.raises(ValueError):
        select_rules(["no-such-rule"])


def test_blanking_keeps_length(spark):
    text = "a `b😀` <!-- c\nd --> http://x.y/z. end\n```\nno x\n```\n"
    got = docs(spark, text).select(blank_markdown(F.col("text")).alias("t")).first().t
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert re.sub(r"\s+", " ", got) == "a . end "


def test_long_text_does_not_overflow(spark):
    long = "wo rd " * 20_000 + "— " * 3_000 + " " * 20_000
    assert scan(docs(spark, long), [r for r in RULES if r.id != "em-dash"]).count() >= 1


def test_places_and_cuts_equal_those_of_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "😀", "\n", " ", "\r\n"]) for _ in range(n)) for n in (1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7)] + ["x" * (3 * BLOCK), "\n" * (2 * BLOCK + 1)]
    offs = [(i, o) for i, t in enumerate(texts) for o in {0, len(t) - 1, *[rng.randrange(len(t)) for _ in range(60)], *[o for k in range(1, 6) for o in (k * BLOCK - 1, k * BLOCK) if o < len(t)]}]
    rows = spark.createDataFrame([(i, texts[i], o, rng.randrange(1, 3000)) for i, o in offs], "i int, text string, off int, n int")
    got = rows.withColumn("t", block_table(F.col("text"))).select("i", "off", "n", place(F.col("t"), F.col("off")).alias("at"), cut(F.col("t"), F.col("off"), F.col("n")).alias("cut")).collect()
    for r in got:
        t = texts[r.i]
        assert (r.at.line, r.at.column) == (t.count("\n", 0, r.off) + 1, r.off - t.rfind("\n", 0, r.off))
        assert r.cut == t[r.off : r.off + r.n]


def test_contexts_equal_those_of_the_whole_text(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["vital role", "plays a vital role", "long" * 12, "\n", "x", "a — b", "load-bearing"]) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    rules = [BY_ID[i] for i in ("em-dash", "load-bearing", "vital-role")]
    notes = scan(docs(spark, *texts), rules).collect()
    whole = [r for r in docs(spark, *texts).select("doc_id", "text", F.explode(F.concat(*[spans(F.col("text"), r) for r in rules])).alias("s")).select("doc_id", context_window(F.col("text"), F.col("s.off"), F.col("s.m")).alias("c")).collect()]
    assert sorted((n.doc_id, n.context) for n in notes) == sorted((r.doc_id, r.c) for r in whole) and len(notes) > 500


def test_eight_times_the_notes_take_less_than_sixteen_times_the_time(spark):
    def took(n, between):
        rows = docs(spark, f"It fell{between}— hard. " * n)
        began = time.time()
        assert scan(rows, [BY_ID["em-dash"]]).where("length(context) > 3 and line + column > 1").count() == n
        return time.time() - began

    for between in (" ", "\n"):
        took(2, between)
        small = min(took(2_500, between) for _ in range(2))
        assert took(20_000, between) < 16 * small


def test_echoes_by_position_equal_the_pattern(spark):
    """Random texts of few words, marks, quotes, hyphens, walls and letters beyond ASCII: the same spans as by the pattern on the whole text."""
    rng = random.Random(12)
    rule = BY_ID["phrase-echo"]
    words = ["shared", "review", "checklist", "list", "shared-review", "don't", "re-shared", "it’shared", "naïve", "Shared", "a", "review's", "e\u0301cole", "lists'", "word9", "under_score"]
    gaps = [" "] * 12 + ["  ", "   ", "\n", "\r\n  ", "\n\n", ", ", ". ", " “", " '", "—", "\n- ", "\n1. ", "\n| ", " " * 85, "’ ", " — ", "'", "-"]
    texts = ["".join(rng.choice(words[: rng.choice([4, 8, 16])]) + rng.choice(gaps[: rng.choice([14, 30])]) for _ in range(rng.randrange(3, 120))) for _ in range(1500)]
    phrase = "shared review checklist"
    texts += [f"{phrase} {'word ' * n}{phrase}." for n in (0, 1, 397, 398, 399, 400, 401, 402, 1500)] + [f"{phrase} {'слово ' * n}{phrase}" for n in (399, 400, 401)] + [f"{phrase} {phrase} {phrase}", "shared " * 40, phrase, "", f"{phrase}\n\n{'-' * 100}\n\n{phrase}", f"{'filler text ' * 400}{phrase} and {phrase}"]
    got = docs(spark, *texts).repartition(4).select("text", spans(F.col("text"), rule).alias("a"), spans(F.col("text"), replace(rule, echo=0)).alias("b")).collect()
    assert all(r.a == r.b for r in got), [(r.text, r.a, r.b) for r in got if r.a != r.b][:2]
    assert sum(len(r.a) for r in got) > 300
