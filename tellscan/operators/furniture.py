"""Lines that aren't prose (headings, list items, tables, code, front matter), as blanks of equal length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellscan.operators.arrays import CHUNK, chunks, let
from tellscan.operators.scan import MARKDOWN_NOISE

#: Fixed value: stands for each character of inline code and URLs; a private code point, so no prose has it.
INLINE = "\ue000"
#: The shapes of lines.
FURNITURE = r"\A[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\||>|[-*_]{3,}[ \t]*\z|\[[^\]]+\]:[ \t]|!\[)"
ORDERED = r"\A[ \t]*\d+[.)][ \t]"
ORDERED_FIRST = r"\A[ \t]*1[.)][ \t]"
BULLET = r"\A[ \t]*[-*+][ \t]"
CONTINUED = r"\A(?: {2,}|\t)\S"
CODE_INDENT = r"\A(?: {4}|\t)"
HTML_LINE = r"\A[ \t]{0,3}</?[A-Za-z][^\n]*>[ \t]*\z"
FRONT = r"\A---[ \t]*\z"
SETEXT_UNDERLINE = r"\A(?:=+|-{2,})[ \t]*\z"
LONE_INLINE = rf"\A[ \t]*{INLINE}[ \t{INLINE}]*\z"
LONE_INLINE_ENDED = rf"\A[ \t]*{INLINE}[ \t{INLINE}]*[.,;:!?)\]]+\z"


def blank_noise(text: Column, inline: str | None) -> Column:
    """text with fenced code and comments as blanks; inline code and URLs as runs of inline, or as they stand if None."""
    between, noise = F.split(text, MARKDOWN_NOISE, -1), F.regexp_extract_all(text, F.lit(MARKDOWN_NOISE), F.lit(0))

    def blanked(m: Column) -> Column:
        block = m.contains("\n") | m.startswith("<!--")
        kept = m if inline is None else F.repeat(F.lit(inline), F.length(m))
        return F.when(block, F.regexp_replace(m, r"[^\n]", " ")).otherwise(kept)

    return F.array_join(F.zip_with(between, noise, lambda p, m: F.concat(p, F.coalesce(blanked(m), F.lit("")))), "")


def _without_ending(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _front_lines(lines: Column) -> Column:
    """How many lines of front matter the text opens with."""
    fence = F.transform(lines, lambda s: F.regexp_like(_without_ending(s), F.lit(FRONT)))
    return let(fence, lambda f: F.when(f[0] & (F.array_position(F.slice(f, 2, F.size(f)), True) > 0), F.array_position(F.slice(f, 2, F.size(f)), True).cast("int") + 1).otherwise(0))


def _shapes(lines: Column) -> Column:
    """What each line looks like alone, and whether an underline makes it a title."""

    def shape(whole: Column, after: Column) -> Column:
        def like(pattern: str):
            return lambda s: F.regexp_like(s, F.lit(pattern))

        def named(s: Column) -> Column:
            blank = ~F.regexp_like(s, F.lit(r"[^\s\x00]"))
            patterns = {"furniture": FURNITURE, "ordered": ORDERED, "first": ORDERED_FIRST, "bullet": BULLET, "continued": CONTINUED, "indented": CODE_INDENT, "html": HTML_LINE, "lone": LONE_INLINE, "ended": LONE_INLINE_ENDED}
            title = ~blank & F.coalesce(F.regexp_like(_without_ending(after), F.lit(SETEXT_UNDERLINE)), F.lit(False))
            return F.struct(blank.alias("blank"), title.alias("title"), *[like(p)(s).alias(n) for n, p in patterns.items()])

        return let(_without_ending(whole), named)

    return F.zip_with(lines, F.slice(lines, 2, F.size(lines)), shape)


#: What a line leaves for the next one: prose; nothing, after a blank or dropped line; a list item; code; code in a list item.
STATES = "PBICX"


def _transitions(shapes: Column, front: Column, markdown: bool) -> Column:
    """array of (next, gone) for each line: for each of STATES before it, in their order, the state after it, and whether the line is dropped (1 or 0)."""

    def line(x: Column, k: Column) -> Column:
        titled = F.coalesce(F.get(shapes, k - 1)["title"], F.lit(False))
        always = (k < front) | x["furniture"] | x["title"] | titled
        if markdown:
            always = always | x["html"] | x["lone"]

        def after(state: str) -> tuple[Column, Column]:
            listed = x["bullet"] | (x["ordered"] if state != "P" else x["ordered"] & x["first"])
            item = (listed | x["continued"]) if state in "IX" else listed
            code = F.lit(False)
            if markdown and state in "CX":
                code = x["indented"] | x["blank"]
            elif markdown and state == "B":
                code = x["indented"]
            gone = always | item | code
            if markdown and state != "P":
                gone = gone | x["ended"]
            to = F.when(item & code, "X").when(item, "I").when(code, "C").when(gone | x["blank"], "B").otherwise("P")
            return to, F.when(gone, "1").otherwise("0")

        all_of = [after(state) for state in STATES]
        plain = ~(always | x["bullet"] | x["ordered"] | x["continued"] | x["indented"] | x["ended"] | x["blank"])
        known = F.struct(F.lit("P" * len(STATES)).alias("next"), F.lit("0" * len(STATES)).alias("gone"))
        return F.when(plain, known).otherwise(F.struct(F.concat(*[t for t, _ in all_of]).alias("next"), F.concat(*[g for _, g in all_of]).alias("gone")))

    return F.transform(shapes, line)


def _then(first: Column, then: Column) -> Column:
    """The states that `then` leads to from those that first leads to: what two transitions do one after the other."""
    return F.call_function("translate", first, F.lit(STATES), then)


def dropped_lines(lines: Column, markdown: bool) -> Column:
    """A string with 1 for each line that is furniture and 0 for each other.

    A line's reading hangs on the one before: whether a list item, a paragraph or code runs on. So each line is a
    function from the state before it to the state after it, and such functions compose: the lines of a chunk make
    one function, these give the state in which each chunk begins, and the chunks are then read apart from each other.
    """
    front = _front_lines(lines) if markdown else F.lit(0)

    def walked(moves: Column) -> Column:
        def of_chunk(c: Column) -> Column:
            return F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, F.size(moves)) - 1)

        def begins(states: Column) -> Column:
            return F.aggregate(states, F.struct(F.lit("B").alias("at"), F.lit("").alias("all")), lambda acc, f: F.struct(_then(acc["at"], f).alias("at"), F.concat(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

        def read(start: Column) -> Column:
            def one(c: Column) -> Column:
                def step(acc: Column, k: Column) -> Column:
                    move = F.get(moves, k)
                    return F.struct(_then(acc["at"], move["next"]).alias("at"), F.concat(acc["out"], _then(acc["at"], move["gone"])).alias("out"))

                return F.aggregate(of_chunk(c), F.struct(F.substring(start, c + 1, F.lit(1)).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

            return F.array_join(F.transform(chunks(F.size(moves)), one), "")

        composed = F.transform(chunks(F.size(moves)), lambda c: F.aggregate(of_chunk(c), F.lit(STATES), lambda acc, k: _then(acc, F.get(moves, k)["next"])))
        return let(begins(composed), read)

    return let(F.struct(_shapes(lines).alias("shapes"), front.alias("front")), lambda x: let(_transitions(x["shapes"], x["front"], markdown), walked))


def _blanked(lines: Column, gone: Column) -> Column:
    def one(line: Column, dropped: Column) -> Column:
        return F.when(dropped == "1", F.regexp_replace(line, r"[^\r]|\r(?!\z)", " ")).otherwise(line)

    return F.array_join(F.zip_with(lines, F.slice(F.split(gone, ""), F.lit(1), F.size(lines)), one), "\n")


def copies(text: Column, markdown: bool = False) -> Column:
    """struct(body, shown): what is split and what a model is shown, each as long as text, furniture blanked in both.

    With markdown, code blocks and comments are blanked in both, inline code and URLs stand as INLINE in body only. A text
    without any furniture comes back as it is.
    """
    body = blank_noise(text, INLINE) if markdown else text
    shown = blank_noise(text, None) if markdown else text

    def both(pair: Column) -> Column:
        lines, seen = F.split(pair["body"], "\n", -1), F.split(pair["shown"], "\n", -1)

        def cut(gone: Column) -> Column:
            same = ~gone.contains("1")
            return F.when(same, pair).otherwise(F.struct(_blanked(lines, gone).alias("body"), _blanked(seen, gone).alias("shown")))

        return let(let(lines, lambda ls: dropped_lines(ls, markdown)), cut)

    return let(F.struct(body.alias("body"), shown.alias("shown")), both)
