import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID, RULES
from tellscan.functions.examples import CASES, LONG
from tellscan.functions.guarded import GUARDED
from tellscan.functions.literals import needed, needed_words
from tellscan.operators.scan import counts, folded, scan, spans


def test_catalogue_is_whole():
    assert set(CASES) == set(BY_ID) and {g["id"] for g in GUARDED} < set(BY_ID)
    assert len({r.suggestion for r in RULES}) > 70 and all(r.rationale for r in RULES)
    assert len(RULES) == len(BY_ID) == 84
    assert [sum(r.severity == s for r in RULES) for s in ("error", "warning", "info")] == [11, 59, 14]
    assert [sum(r.confidence == c for r in RULES) for c in ("high", "medium", "low")] == [48, 31, 5]


@pytest.fixture(scope="module")
def found(spark):
    texts = [(i, k, t) for i, pair in CASES.items() for k, t in enumerate(pair)]
    docs = spark.createDataFrame([(n, t) for n, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.rule): r.n for r in counts(docs, [BY_ID[i] for i in CASES]).collect()}
    return {(i, k): got[(n, i)] for n, (i, k, _) in enumerate(texts)}


@pytest.mark.parametrize("rule", CASES)
def test_example_and_counterexample(found, rule):
    assert (found[(rule, 0)], found[(rule, 1)]) == (2 if rule == "em-dash" else 1, 0)


#: Pairs of rules that one text may set off together: the wider of the two, and what it holds.
TOGETHER = {("em-dash", "em-dash-overuse"), ("honest-x", "most-honest-x")}


def test_no_text_is_noted_twice(spark):
    """A sentence for one rule sets off no other rule at the same place, unless that is meant."""
    docs = spark.createDataFrame([(i, pair[0]) for i, pair in CASES.items()], "doc_id string, text string")
    rules = [r for r in RULES if r.confidence != "low"]
    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), spans(F.col("text"), r).alias("found")) for r in rules])
    at = {}
    for r in docs.select("doc_id", F.inline(each)).where(F.size("found") > 0).collect():
        at.setdefault(r.doc_id, []).append((r.rule, {x for s in r.found for x in range(s.off, s.off + len(s.m))}))
    for rule, found in at.items():
        own = set().union(*(s for r, s in found if r == rule))
        assert all(r == rule or not s & own or tuple(sorted((r, rule))) in TOGETHER for r, s in found), (rule, [r for r, _ in found])


def test_needed_words():
    assert needed(r"\bplays?\s+a\s+(?:vital|key)\s+role\b") == {"role"}
    assert needed(r"(?:ab|cde)?x+yz") == {"yz"} and needed(r"a|(?:b)?") is None and needed(r"[xy]\w+") is None
    assert needed(r"(?!no)(?:one|two{2})(?=three)") == {"one", "two"} and needed(r"don't{0,2}z") == {"don'"}
    assert needed_words(r"\bſtop|k\b") and needed(r"it’s") == {"it’s"}


def test_needed_words_lose_no_note(spark):
    """Every rule finds as much behind its search for words as without it, whatever the case of the letters."""
    texts = [t for pair in CASES.values() for t in pair]
    texts += [t.upper() for t in texts] + [t.replace("k", "\u212a").replace("s", "ſ") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("low", folded(F.col("text")))
    for part in (RULES[:42], RULES[42:]):
        both = [F.size(spans(F.col("text"), r)) == F.size(spans(F.col("text"), r, F.col("low"))) for r in part]
        assert docs.select(*[c.alias(r.id) for c, r in zip(both, part, strict=True)]).where(" or ".join(f"not `{r.id}`" for r in part)).isEmpty()


def test_hints_lose_no_note(spark):
    """On texts of short and long sentences dealt at random, a rule with a hint finds what it finds without."""
    rng = random.Random(83)
    parts = ["Rain fell.", "We went home.", "They stayed.", "No one came!", f"{LONG}.", f"{LONG}?", "Nothing was decided.", "The mayor did.", "Never again.", "Lovely.", "See p. 3.", "It is a.", "The end"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\n\n", "\n  "]) for _ in range(rng.randrange(3, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hinted = [r for r in RULES if r.hint]
    got = docs.select(*[F.struct(spans(F.col("text"), r).alias("a"), spans(F.col("text"), replace(r, hint="")).alias("b")).alias(r.id) for r in hinted]).collect()
    for r in hinted:
        assert all(x[r.id].a == x[r.id].b for x in got) and any(x[r.id].a for x in got), r.id


def test_sentences_that_fail_are_passed_over_once(spark):
    """What idle passes over holds no note: the spans are those of the pattern without it."""
    texts = [f"{LONG}. Never again. {LONG}\n{LONG}. Nothing was decided.\n\nA line\nwithout a stop\n{LONG}! {LONG}. The mayor did.", f"{LONG}\n\n{LONG}, 3.5 more; {LONG}. Most of it was lost.", "x. " * 40 + f"{LONG}.  None of that. {LONG} again and again."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in (r for r in RULES if r.idle):
        got = docs.select(spans(F.col("text"), r).alias("a"), spans(F.col("text"), replace(r, idle="", hint="")).alias("b")).collect()
        assert all(x.a == x.b for x in got) and any(x.a for x in got), r.id


def test_prefix_is_left_out(spark):
    note = scan(spark.createDataFrame([(1, f"{LONG}. Nothing was decided.")], "doc_id long, text string"), [BY_ID["mic-drop-closer"]]).first()
    assert (note.excerpt, note.column) == ("Nothing was decided.", len(LONG) + 3)


def test_counted_groups(spark):
    note = scan(spark.createDataFrame([(1, "One road, one bridge, and one gate.")], "doc_id long, text string"), [BY_ID["one-x-one-y"]]).first()
    assert note["count"] == 3 and note.message == "A chain of 3 single items."


def test_long_texts_do_not_overflow(spark):
    """All rules, the long texts whole: none runs out of stack, and none takes a time quadratic in lines."""
    texts = ["word " * 25_000, "is not just " + "a\n" * 30_000, "No a. " * 8_000, "one a, " * 8_000, "x" * 60_000 + ". Nothing was. ", "from a to b, " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    assert counts(docs.repartition(4), list(RULES)).count() == len(texts) * len(RULES)
    lines = time.time()
    assert counts(docs.where("doc_id = 1"), [r for r in RULES if r.idle]).where("n > 0").isEmpty()
    assert time.time() - lines < 20 and lines - began < 120
