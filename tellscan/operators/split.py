"""Paragraphs and sentences with their offsets, as array columns. Headings, bullets, tables and the like are blanked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.operators.furniture import INLINE, copies
from tellscan.operators.arrays import fold, let
from tellscan.operators.scan import SIDE, squash
from tellscan.operators.table import block_table, cut

#: What separates paragraphs and sentences, and what ends a piece that goes on.
PARAGRAPH_BREAK = r"\r?\n[ \t ]*\r?\n"
SENTENCE_BREAK = rf"""(?<=[.!?]|[.!?]["'”’)\]])\s+(?=["'“‘(\[A-Z0-9{INLINE}])"""
GOES_ON = r"\b(?:e\.g|i\.e|vs|etc|cf|Fig|No|Dr|Mr|Mrs|Ms|St|Inc|Ltd|Sec|Ch|Vol)\.\z|(?<!\p{IsAlphabetic})(?:\p{IsAlphabetic}\.){2,6}\z|\A\d+\.\z"
SPAN = "array<struct<offset:int,length:int,line:int,column:int,text:string>>"
#: Characters before and after a paragraph that go with it: one more than a note's context takes.
NEAR = SIDE + 1
#: Where a paragraph stands: its line and column, its own characters, and those near it.
AROUND = ("line", "column", "written", "before", "after")
SENTENCE = "array<struct<offset:int,length:int,text:string,asked:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """array of (p, g): each piece and the gap after it, null after the last."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("g"))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def paragraphs(text: Column) -> Column:
    """array of (offset, length, line, column, text): blocks between blank lines, trimmed; offset is a code point of text, from 0."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        lead = F.length(x["p"]) - F.length(F.regexp_replace(x["p"], r"\A[\s\x00]+", ""))
        before = F.substring(x["p"], F.lit(1), lead)
        body = F.regexp_replace(x["p"], r"\A[\s\x00]+|[\s\x00]+\z", "")
        place = (acc["line"] + _breaks(before)).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column")  # a piece begins a line
        new = F.array(F.struct((acc["at"] + lead).alias("offset"), F.length(body).alias("length"), *place, body.alias("text")))
        whole = F.concat(x["p"], F.coalesce(x["g"], F.lit("")))
        return {"at": acc["at"] + F.length(whole), "line": acc["line"] + _breaks(whole)}, F.when(body == "", F.array().cast(SPAN)).otherwise(new)

    return fold(_pieces(text, PARAGRAPH_BREAK), {"at": F.lit(0), "line": F.lit(1)}, SPAN, step)


def sentences(body: Column, base: Column, text: Column | None = None, shown: Column | None = None) -> Column:
    """array of (offset, length, text, asked) in a trimmed paragraph; a piece that ends in an abbreviation, initials or is a bare number goes on.

    Breaks are looked for in body; text and asked are cut at the same places from text and shown, by default from body.
    """
    text = body if text is None else text
    shown = text if shown is None else shown

    def all_of(own: Column) -> Column:
        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
            start = F.coalesce(acc["start"], acc["at"])
            end = acc["at"] + F.length(x["p"])
            raw = F.concat(acc["raw"], x["p"])
            more = x["g"].isNotNull() & F.regexp_like(x["p"], F.lit(GOES_ON))
            pieces = [squash(F.when(own[n].isNull(), raw).otherwise(cut(own[n], start, end - start))).alias(n) for n in ("text", "asked")]
            new = F.array(F.struct((base + start).alias("offset"), (end - start).alias("length"), *pieces))
            after = {"at": end + F.coalesce(F.length(x["g"]), F.lit(0)), "start": F.when(more, start), "raw": F.when(more, F.concat(raw, x["g"])).otherwise(F.lit(""))}
            return after, F.when(more, F.array().cast(SENTENCE)).otherwise(new)

        return fold(_pieces(body, SENTENCE_BREAK), {"at": F.lit(0), "start": F.lit(None).cast("int"), "raw": F.lit("")}, SENTENCE, step)

    # where nothing was blanked, a sentence is its pieces; else it is cut from the blocks it stands in
    tables = [F.when(c != body, block_table(c)).alias(n) for c, n in ((text, "text"), (shown, "asked"))]
    return let(F.struct(*tables), all_of)


def _lines(lines: Column, first: Column, last: Column) -> Column:
    """The lines from first to last, from 0, as one text; empty where there are none."""
    first = F.greatest(first, F.lit(0))
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(last, first)), lambda k: F.get(lines, k)), "\n"))


def _cut(text: Column, markdown: bool, around: bool) -> Column:
    """array of (offset, length, line, column, body, text, shown): each paragraph as it is split, as it is written and as it is asked about.

    With around, before and after, too: what stands around it. All is cut from the lines that a paragraph and its neighbours
    stand on, since the copies of a text have their line ends at the same places; so no text is walked for each paragraph.
    """

    def each(c: Column) -> Column:
        def with_lines(own: Column, shown: Column, ends: Column | None, starts: Column | None) -> Column:
            def one(p: Column) -> Column:
                first = p["line"] - 1
                last = first + _breaks(p["text"])

                def at(copy: Column, lines: Column) -> Column:
                    return F.when(copy == c["body"], p["text"]).otherwise(F.substring(_lines(lines, first, last), p["column"], p["length"]))

                fields = [p[f].alias(f) for f in ("offset", "length", "line", "column")] + [p["text"].alias("body"), at(text, own).alias("text"), at(c["shown"], shown).alias("shown")]
                if ends is not None:
                    # a line end is a character, so NEAR lines hold at least as many
                    before = F.concat(_lines(ends, first - NEAR, first - 1), F.when(first > 0, "\n").otherwise(""), F.substring(F.get(own, first), F.lit(1), p["column"] - 1))
                    left = F.when(last == first, p["column"] + p["length"]).otherwise(F.length(F.substring_index(p["text"], "\n", -1)) + 1)
                    rest = F.substring(F.get(own, last), left, F.lit(NEAR))
                    more = F.when(last + 1 < F.size(own), F.concat(F.lit("\n"), _lines(starts, last + 1, F.least(last + NEAR, F.size(own) - 1)))).otherwise("")
                    fields += [F.substring(before, F.greatest(F.length(before) - (NEAR - 1), F.lit(1)), F.lit(NEAR)).alias("before"), F.substring(F.concat(rest, more), F.lit(1), F.lit(NEAR)).alias("after")]
                return F.struct(*fields)

            return F.transform(paragraphs(c["body"]), one)

        def near(own: Column, shown: Column) -> Column:
            if not around:
                return with_lines(own, shown, None, None)
            last_of = F.transform(own, lambda x: F.substring(x, F.greatest(F.length(x) - (NEAR - 1), F.lit(1)), F.lit(NEAR)))
            return let(last_of, lambda ends: let(F.transform(own, lambda x: F.substring(x, 1, NEAR)), lambda starts: with_lines(own, shown, ends, starts)))

        return let(F.split(text, "\n", -1), lambda own: let(F.split(c["shown"], "\n", -1), lambda shown: near(own, shown)))

    return let(copies(text, markdown), each)


def split(docs: DataFrame, key: str = "doc_id", text_col: str = "text", markdown: bool = False, around: bool = False) -> DataFrame:
    """key, paragraph, offset, length, text, asked, sentences (and AROUND): a row for each paragraph. Null and blank texts have none.

    Furniture is no paragraph. With markdown, nor are code, comments, front matter and a lone sentence before a colon.
    """
    rows = docs.select(F.col(key), F.posexplode(_cut(F.col(text_col), markdown, around)).alias("paragraph", "x")).select(key, "paragraph", "x.*")
    found = rows.withColumn("sentences", sentences(F.col("body"), F.col("offset"), F.col("text"), F.col("shown")))
    if markdown:
        found = found.where((F.size("sentences") != 1) | ~F.col("body").endswith(":"))
    more = [F.col("line"), F.col("column"), F.col("text").alias("written"), F.col("before"), F.col("after")] if around else []
    return found.select(key, "paragraph", "offset", "length", squash(F.col("text")).alias("text"), squash(F.col("shown")).alias("asked"), "sentences", *more)
