"""The scan: documents against rules, a note for every match. One projection; no shuffle, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.functions.catalog import Rule, select_rules
from tellscan.functions.literals import needed_words
from tellscan.operators.arrays import fold, let
from tellscan.operators.echo import echo_spans
from tellscan.operators.table import after_last_line_end, block_table, cut, place

#: Context on each side of a match, and the length of a match that needs none.
SIDE, ALONE = 40, 40
#: Fixed value: what Markdown blanking blanks, the first opened winning.
MARKDOWN_NOISE = r"(?md)(?s:^[ \t]*`{3,}[^\n]*\n.*?^[ \t]*`{3,}[ \t]*$|<!--.*?-->)|`[^`\n]*`|https?://\S*[^\s.,;:!?)\]]"
NOTE_FIELDS = ("line", "column", "severity", "confidence", "rule", "category", "message", "excerpt", "context", "count", "rationale", "suggestion")


def blank_markdown(text: Column) -> Column:
    """text with code, comments and URLs as blanks of equal length, line breaks kept."""
    between = F.split(text, MARKDOWN_NOISE, -1)
    noise = F.regexp_extract_all(text, F.lit(MARKDOWN_NOISE), F.lit(0))
    return F.array_join(F.zip_with(between, noise, lambda p, m: F.concat(p, F.coalesce(F.regexp_replace(m, r"[^\n]", " "), F.lit("")))), "")


def squash(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def folded(text: Column) -> Column:
    """text in which needed words are found whatever their case, the four characters included that patterns take for Latin letters."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def hopeful(text: Column, low: Column, rule: Rule) -> Column | None:
    """Whether a text, folded to low, holds what every match needs; None where the rule has no such thing."""
    found = [F.contains(low, F.lit(w)) for w in needed_words(rule.pattern)]
    return reduce(Column.__or__, found) if found else None


PIECES = "array<struct<ord:int,first:boolean,p:int,g:int,m:string>>"
SPANS = "array<struct<ord:int,off:int,m:string>>"


def _pieces(text: Column, rule: Rule, low: Column | None, ord: int = 0) -> Column:
    """array of (ord, first, p, g, m): lengths of what stands before a match and of the match, and what is reported of it; null m for none.

    The pattern runs only where the text holds a needed word, and its places are taken only where it matches.
    """
    groups = {"g": 0} | ({"b": 2} if rule.prefix or rule.idle else {})
    cut_out = F.arrays_zip(F.split(text, rule.regex, -1).alias("p"), *[F.regexp_extract_all(text, F.lit(rule.regex), F.lit(n)).alias(c) for c, n in groups.items()])

    def piece(x: Column, k: Column) -> Column:
        m = x["b"] if "b" in groups else x["g"]
        kept = m != ""
        for skip in rule.skip:
            kept = kept & ~F.regexp_like(m, F.lit(skip))
        return F.struct(F.lit(ord).alias("ord"), (k == 0).alias("first"), F.length(x["p"]).alias("p"), F.length(x["g"]).alias("g"), F.when(kept, m).alias("m"))

    may = [] if low is None or (words := hopeful(text, low, rule)) is None else [words]
    may += [F.regexp_like(text, F.lit(rule.flags + rule.hint))] if rule.hint else []
    may += [] if rule.idle else [F.regexp_like(text, F.lit(rule.regex))]
    found = F.transform(cut_out, piece)
    return F.when(reduce(Column.__and__, may), found).otherwise(F.array().cast(PIECES)) if may else found


def _placed(pieces: Column) -> Column:
    """array of (ord, off, m) of the pieces that are reported, rule by rule and from left to right."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        end = F.when(x["first"], F.lit(0)).otherwise(acc["at"]) + x["p"] + F.coalesce(x["g"], F.lit(0))
        new = F.when(x["m"].isNull(), F.array().cast(SPANS)).otherwise(F.array(F.struct(x["ord"].alias("ord"), (end - F.length(x["m"])).alias("off"), x["m"].alias("m"))))
        return {"at": end}, new

    return fold(pieces, {"at": F.lit(0)}, SPANS, step)


def _echoes(text: Column, rule: Rule, ord: int) -> Column:
    return F.transform(echo_spans(text, rule), lambda s: F.struct(F.lit(ord).alias("ord"), s["off"].alias("off"), s["m"].alias("m")))


def all_spans(text: Column, rules: Sequence[Rule], low: Column | None = None) -> Column:
    """array of (ord, off, m): the rule's place in rules, 0-based code point offset and text of each match. low is the folded text."""
    pieces = [_pieces(text, r, low, i) for i, r in enumerate(rules) if not r.echo]
    echoes = [_echoes(text, r, i) for i, r in enumerate(rules) if r.echo]
    return F.concat(*([_placed(F.concat(*pieces))] if pieces else []), *echoes)


def spans(text: Column, rule: Rule, low: Column | None = None) -> Column:
    """array of (off, m) of a rule's matches, left to right."""
    return F.transform(all_spans(text, [rule], low), lambda s: F.struct(s["off"].alias("off"), s["m"].alias("m")))


def n_notes(text: Column, rule: Rule, low: Column) -> Column:
    """How many notes of the rule a text has; 0 for a null text."""
    if rule.echo:
        return F.coalesce(F.size(echo_spans(text, rule)), F.lit(0))
    if rule.skip or rule.idle:
        return F.coalesce(F.size(F.filter(_pieces(text, rule, low), lambda x: x["m"].isNotNull())), F.lit(0))
    words, n = hopeful(text, low, rule), F.regexp_count(text, F.lit(rule.regex))
    return F.coalesce(n, F.lit(0)) if words is None else F.when(words, n).otherwise(F.lit(0))


def column_of(text: Column, off: Column) -> Column:
    """1-based column of a 0-based offset in a short text; only line feeds end lines."""
    return F.length(after_last_line_end(F.substring(text, F.lit(1), off))) + 1


def context_window(text: Column, off: Column, m: Column) -> Column:
    """A long match alone in brackets, else the match between SIDE characters of a short text on each side."""
    start = F.greatest(off - SIDE - 1, F.lit(0))
    return _window(F.substring(text, start + 1, off - start + F.length(m) + SIDE + 1), off - start, F.length(m))


def context_at(table: Column, off: Column, length: Column) -> Column:
    """context_window() of so many characters of the text of a table."""
    start = F.greatest(off - SIDE - 1, F.lit(0))
    return let(cut(table, start, off - start + length + SIDE + 1), lambda near: _window(near, off - start, length))


def _window(near: Column, before: Column, length: Column) -> Column:
    """near holds the match, and on each side a character more than is shown where the text goes on."""
    pre = F.when(before > SIDE, F.concat(F.lit("…"), F.regexp_replace(F.substring(near, before - SIDE + 1, F.lit(SIDE)), r"\A\S*\s+", ""))).otherwise(F.substring(near, F.lit(1), before))
    rest = F.substring(near, before + length + 1, F.lit(SIDE))
    rest = F.when(F.length(near) > before + length + SIDE, F.concat(F.regexp_replace(rest, r"\s\S*\z", ""), F.lit("…"))).otherwise(rest)
    own = F.substring(near, before + 1, length)
    return F.when(length >= ALONE, F.concat(F.lit("["), squash(own), F.lit("]"))).otherwise(squash(F.concat(pre, own, rest)))


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, key: str = "doc_id", text_col: str = "text", markdown: bool = False) -> DataFrame:
    """key and the note's fields for every match of the rules (by default those that aren't low).

    Matches are found in the blanked text if markdown, and quoted in context from the text as it stands. ord, the rule's
    place in the catalogue, settles ties of line and column. Null texts have no notes.
    """
    rules = select_rules() if rules is None else list(rules)
    kept = docs.select(F.col(key), F.col(text_col).alias("source")).where(F.col("source").isNotNull())
    kept = kept.withColumn("body", blank_markdown(F.col("source")) if markdown else F.col("source")).withColumn("low", folded(F.col("body")))

    if not rules:
        raise ValueError("no rules")
    of = ("severity", "confidence", "id", "category", "message", "count_group", "rationale", "suggestion")
    catalog = F.array(*[F.struct(*[F.lit(getattr(r, name)).cast("string").alias(name) for name in of]) for r in rules])

    def note(table: Column) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            def said(r: Column) -> Column:
                count = F.when(r["count_group"].isNotNull(), F.regexp_count(s["m"], F.coalesce(r["count_group"], F.lit("")))).cast("int")
                message = F.when(r["count_group"].isNull(), r["message"]).otherwise(F.replace(r["message"], F.lit("%{count}"), count.cast("string")))
                at = place(table, s["off"])
                own = {"line": at["line"], "column": at["column"], "rule": r["id"], "message": message, "excerpt": squash(s["m"]), "context": context_at(table, s["off"], F.length(s["m"])), "count": count}
                return F.struct(*[own.get(name, r[name] if name in of else F.lit(None)).alias(name) for name in NOTE_FIELDS], s["ord"].alias("ord"))

            return let(F.get(catalog, s["ord"]), said)

        return one

    def notes(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(block_table(F.col("source")), lambda table: F.transform(found, note(table))))

    return kept.select(key, F.inline(let(all_spans(F.col("body"), rules, F.col("low")), notes)))


def counts(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, rule, n for every row and rule, n being the number of matches that aren't skipped."""
    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), n_notes(F.col("body"), r, F.col("low")).cast("long").alias("n")) for r in rules])
    return docs.select(key, F.col(text_col).alias("body"), folded(F.col(text_col)).alias("low")).select(key, F.inline(each))
