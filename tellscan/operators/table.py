"""A text in blocks that know where they stand, so that a place is found without walking the text to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellscan.operators.arrays import fold, let

#: Characters of a block.
BLOCK = 1024
KIND = "array<struct<s:string,line:int,column:int>>"


def line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def after_last_line_end(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def block_table(text: Column) -> Column:
    """array of (s, line, column): the text in blocks of BLOCK characters, each with the line and column at which it begins."""

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
        here = F.array(F.struct(s.alias("s"), acc["line"].alias("line"), acc["column"].alias("column")))
        return {"line": acc["line"] + line_ends(s), "column": F.when(F.contains(s, F.lit("\n")), F.length(after_last_line_end(s)) + 1).otherwise(acc["column"] + F.length(s))}, here

    return fold(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), {"line": F.lit(1), "column": F.lit(1)}, KIND, step)


def _block(off: Column) -> Column:
    return F.floor(off / BLOCK).cast("int")


def place(table: Column, off: Column) -> Column:
    """struct(line, column), from 1, of a 0-based offset inside the text; only line feeds end lines."""

    def in_block(b: Column) -> Column:
        def of(pre: Column) -> Column:
            column = F.when(F.contains(pre, F.lit("\n")), F.length(after_last_line_end(pre)) + 1).otherwise(b["column"] + F.length(pre))
            return F.struct((b["line"] + line_ends(pre)).alias("line"), column.alias("column"))

        return let(F.substring(b["s"], F.lit(1), F.pmod(off, F.lit(BLOCK)).cast("int")), of)

    return let(F.get(table, _block(off)), in_block)


def cut(table: Column, start: Column, length: Column) -> Column:
    """The characters from a 0-based start on, from the blocks they are in; fewer where the text ends."""
    last = F.least(F.greatest(_block(start + length - 1), _block(start)), F.size(table) - 1)
    joined = F.array_join(F.transform(F.sequence(_block(start), F.greatest(last, _block(start))), lambda k: F.get(table, k)["s"]), "")
    return F.substring(joined, F.pmod(start, F.lit(BLOCK)).cast("int") + 1, length)
