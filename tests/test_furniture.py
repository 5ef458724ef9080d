import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID
from tellscan.operators.arrays import let
from tellscan.operators.furniture import INLINE, copies, dropped_lines
from tellscan.operators.scan import scan
from tellscan.operators.split import split

TEXT = """---
title: x
---
Heading one
===========

# Hash heading
Prose under it goes on. It has `code` here. `make it` runs.
- bullet
  wrapped bullet
1. first
   more

It was released in
2019. Then it went
1. listed again

    indented code

```
Fenced. Code.
```
<details>
| a | b |
> quoted
See https://example.org/x. Then stop.

https://example.org/lone

The list is this:

[ref]: http://x.y
![img](a.png)
<!-- gone
too -->
Two 😀 lines. End.
"""


def split_texts(spark, text, markdown):
    rows = split(spark.createDataFrame([(1, text)], "doc_id long, text string"), markdown=markdown).orderBy("paragraph").collect()
    for r in rows:
        for s in r.sentences:
            assert re.sub(r"\s+", " ", text[s.offset : s.offset + s.length]) == s.text
    return [[s.text for s in r.sentences] for r in rows]


def test_markdown_leaves_prose(spark):
    got = split_texts(spark, TEXT, True)
    assert got == [
        ["Prose under it goes on.", "It has `code` here.", "`make it` runs."],
        ["It was released in 2019.", "Then it went"],
        ["See https://example.org/x.", "Then stop."],
        ["Two 😀 lines.", "End."],
    ]


def test_plain_keeps_what_only_markdown_drops(spark):
    got = [s for p in split_texts(spark, TEXT, False) for s in p]
    assert "indented code" in got and "The list is this:" in got and "https://example.org/lone" in got
    assert not any("bullet" in s or "Heading" in s or "quoted" in s for s in got)


@pytest.mark.parametrize("markdown", [False, True])
def test_copies_keep_lengths_and_line_ends(spark, markdown):
    texts = [TEXT, TEXT.replace("\n", "\r\n"), "", "\n", "- a", "- a\r", "a\n---\n", "---\na", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.inline(F.array(copies(F.col("text"), markdown)))).collect()
    for r in rows:
        if r.text is None:
            assert r.body is None
            continue
        assert len(r.body) == len(r.shown) == len(r.text)
        assert [i for i, c in enumerate(r.body) if c == "\n"] == [i for i, c in enumerate(r.text) if c == "\n"]
        assert all(a in (b, " ", INLINE) for a, b in zip(r.body, r.text, strict=True))
    assert {r.text: r.body for r in rows}["- a\r"] == "   \r"
    assert {r.text: r.body for r in rows}["a\n---\n"].strip() == ""


def test_crlf_splits_alike(spark):
    """But for fences, whose closing line must end in a line feed alone."""
    TEXT = re.sub(r"```\n.*?```\n", "", globals()["TEXT"], flags=re.S)
    assert split_texts(spark, TEXT.replace("\n", "\r\n"), True) == split_texts(spark, TEXT, True)


def test_many_lines(spark):
    text = "- item\nSome prose here. And more.\n\n" * 10_000
    assert split(spark.createDataFrame([(1, text)], "doc_id long, text string"), markdown=True).count() == 10_000


def test_pieces_beyond_one_chunk_take_their_share_of_time(spark):
    """Three times CHUNK pieces and more: offsets run on over chunks, and 20,000 sentences take no time that grows with their square."""
    text = "e.g. One. " + "Two words.\n" * 700 + "Fig. 3.\n\nAn end. U.S. Trade — fell — too. " * 600
    rows = split(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("paragraph").collect()
    assert len(rows) == 601 and len(rows[0].sentences) == 702
    assert all(" ".join(text[s.offset : s.offset + s.length].split()) == s.text for r in rows for s in r.sentences)
    assert all(text[r.offset : r.offset + r.length].split() == r.text.split() for r in rows)
    notes = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [BY_ID["em-dash"]])
    assert notes.count() == 1200 and notes.select(F.max("line")).first()[0] == text.count("\n") + 1


def took(spark, text: str, markdown: bool, around: bool) -> float:
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert split(rows, markdown=markdown, around=around).selectExpr("sum(size(sentences))").first()[0] > 0
    return time.time() - began


@pytest.mark.parametrize(("text", "markdown", "around"), [("A sentence of words. ", False, False), ("A paragraph.\n\n", False, False), ("A paragraph.\n\n", False, True), ("- x\n  y\n\nA `p` paragraph.\n\n", True, True), ("# a\n", True, False), ("Words and `code`.\n", True, True)])
def test_eight_times_the_text_takes_less_than_sixteen_times_the_time(spark, text, markdown, around):
    tail = "\n\nIt ends. Here."
    took(spark, text + tail, markdown, around)
    small = min(took(spark, text * 2_000 + tail, markdown, around) for _ in range(2))
    assert took(spark, text * 16_000 + tail, markdown, around) < 16 * small


def naive_dropped(text: str, markdown: bool) -> str:
    """Which lines go, by a walk with flags of its own."""
    lines, out = [x.removesuffix("\r") for x in text.split("\n")], ""
    front = next((k + 1 for k in range(1, len(lines)) if re.fullmatch(r"---[ \t]*", lines[k])), 0) if markdown and re.fullmatch(r"---[ \t]*", lines[0]) else 0
    prose = item = code = titled = False
    opens = True
    under = [bool(re.fullmatch(r"(?:=+|-{2,})[ \t]*", x)) for x in lines]
    for k, x in enumerate(lines):
        blank = not x.strip()
        title = not blank and k + 1 < len(lines) and under[k + 1]
        indented, ordered = bool(re.match(r" {4}|\t", x)), re.match(r"[ \t]*(\d+)[.)][ \t]", x)
        listed = bool(re.match(r"[ \t]*[-*+][ \t]", x)) or bool(ordered) and (not prose or ordered[1] == "1")
        on = item and bool(re.match(r"(?: {2,}|\t)\S", x))
        code = markdown and (code and (indented or blank) or indented and not item and opens)
        gone = k < front or code or listed or on or title or titled or bool(re.match(r"[ \t]*(?:#{1,6}[ \t]|\||>|[-*_]{3,}[ \t]*$|\[[^\]]+\]:[ \t]|!\[)", x))
        gone = gone or markdown and (bool(re.fullmatch(r"[ \t]{0,3}</?[A-Za-z].*>[ \t]*", x)) or bool(re.fullmatch(rf"[ \t]*{INLINE}[ \t{INLINE}]*", x)) or not prose and bool(re.fullmatch(rf"[ \t]*{INLINE}[ \t{INLINE}]*[.,;:!?)\]]+", x)))
        prose, item, opens, titled = not gone and not blank, listed or on, blank or gone, title
        out += "01"[gone]
    return out


@pytest.mark.parametrize("markdown", [False, True])
def test_composed_lines_equal_a_walk(spark, markdown):
    """Random lines, over many chunks too: functions that compose give what a walk from line to line gives."""
    rng = random.Random(9)
    parts = ["Prose here.", "- item", "  goes on", "1. first", "2. second", "    indented", "\tTab", "# H", "Title", "===", "---", "--- ", "| a |", "> q", "<div>", INLINE * 3, f"{INLINE}.", "", "", " ", "word\r", "![i](x)", "[r]: u", "    ", "10) ten", "***"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["---\n" + "\n".join(rng.choice(parts) for _ in range(n)) for n in (255, 256, 257, 700, 1500)] + ["", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", let(F.split("text", "\n", -1), lambda x: dropped_lines(x, markdown)).alias("gone")).collect()
    assert all(r.gone == naive_dropped(r.text, markdown) for r in rows) and len(rows) == len(texts)


def test_surroundings_are_those_of_the_text(spark):
    rng = random.Random(8)
    parts = ["Prose here. And more.", "", "", "- item", "x" * 90, "é😀 x.", " lead", "trail  "]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    rows = split(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), around=True).collect()
    for r in rows:
        t, end = texts[r.doc_id], r.offset + r.length
        assert (r.before, r.after) == (t[max(r.offset - 41, 0) : r.offset], t[end : end + 41])
        assert (r.line, r.column) == (t.count("\n", 0, r.offset) + 1, r.offset - t.rfind("\n", 0, r.offset))
    assert len(rows) > 1000
