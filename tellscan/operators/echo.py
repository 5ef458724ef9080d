"""A phrase that comes back, by positions: words that begin the same run again soon after, and only there the pattern.

The pattern looks ahead over some hundred words from every word of a text. So it is tried only where its first words
stand again within reach, found by sorting the runs of words by what they are and then by where, and comparing each
with the next; what it finds there is what it would find alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellscan.functions.catalog import Rule
from tellscan.functions.guarded import LETTER
from tellscan.operators.arrays import fold, let
from tellscan.operators.table import block_table, cut

#: Words from the begin of a phrase to the begin of its repeat, parts of joined words counted apart: more than the pattern passes over.
REACH = 1000
#: Words whose lengths are summed up together.
MARK = 64
SPANS = "array<struct<off:int,m:string>>"


def _again(words: Column) -> Column:
    """Ascending numbers of the words at which a run of three begins that begins again within REACH; of the third, three letters."""

    def runs(w: Column) -> Column:
        def key(i: Column) -> Column:
            return F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.substring(F.get(w, i + 2), 1, 3)).alias("h"), i.alias("i"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), key))

    def near(r: Column) -> Column:
        def next_is_same(x: Column, k: Column) -> Column:
            after = F.get(r, k + 1)
            return F.when((x["h"] == after["h"]) & (after["i"] - x["i"] <= REACH), x["i"])

        return F.sort_array(F.array_compact(F.transform(r, next_is_same)))

    return let(words, lambda w: F.when(F.size(w) > 3, let(runs(w), near)).otherwise(F.array().cast("array<int>")))


def echo_spans(text: Column, rule: Rule) -> Column:
    """array of (off, m) as spans() gives them, for a rule whose pattern looks for its own first three words again."""
    pattern = rf"{rule.flags}\A[\s\S]()({rule.pattern})"
    word = rf"[{LETTER}]+"

    def placed(words: Column, at: Column) -> Column:
        # characters before each word, summed up MARK words at a time
        def lengths(gaps: Column) -> Column:
            each = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))

            def marks(n: Column) -> Column:
                parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / MARK).cast("int")), lambda k: F.aggregate(F.slice(n, k * MARK + 1, F.lit(MARK)), F.lit(0), lambda a, x: a + x))
                starts = fold(parts, {"at": F.lit(0)}, "array<int>", lambda acc, x: ({"at": acc["at"] + x}, F.array(acc["at"])))

                def start(m: Column, i: Column) -> Column:
                    first = F.floor(i / MARK).cast("int")
                    return F.get(m, first) + F.aggregate(F.slice(n, first * MARK + 1, i - first * MARK), F.lit(0), lambda a, x: a + x) + F.length(F.get(gaps, i))

                def found(m: Column, table: Column) -> Column:
                    def step(acc: Column, i: Column) -> tuple[dict[str, Column], Column]:
                        def tried(off: Column) -> Column:
                            # from the character before the phrase to the end of a word well beyond the repeat
                            end = F.least(i + REACH + 8, F.size(words) - 1)
                            length = start(m, end) + F.length(F.get(words, end)) - off
                            piece = F.when(off == 0, F.concat(F.lit("\n"), cut(table, off, length))).otherwise(cut(table, off - 1, length + 1))
                            return F.struct(off.alias("off"), F.when(off >= acc["end"], F.regexp_extract(piece, pattern, 2)).otherwise("").alias("m"))

                        hit = let(start(m, i), tried)
                        new = let(hit, lambda x: F.when(x["m"] != "", F.array(x)).otherwise(F.array().cast(SPANS)))
                        return {"end": let(new, lambda x: F.when(F.size(x) > 0, F.get(x, 0)["off"] + F.length(F.get(x, 0)["m"])).otherwise(acc["end"]))}, new

                    return fold(at, {"end": F.lit(0)}, SPANS, step)

                return let(starts, lambda m: let(block_table(text), lambda table: found(m, table)))

            return let(each, marks)

        return let(F.split(text, word, -1), lengths)

    def candidates(words: Column) -> Column:
        begins = F.filter(_again(words), lambda i: F.regexp_like(F.get(words, i), F.lit("^[a-z]")))
        return let(begins, lambda at: F.when(F.size(at) > 0, placed(words, at)).otherwise(F.array().cast(SPANS)))

    return let(F.regexp_extract_all(text, F.lit(word), F.lit(0)), candidates)
