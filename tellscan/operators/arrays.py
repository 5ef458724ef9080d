"""Small helpers for array columns: a name for a value, and a fold whose copies don't grow with the square of its steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


#: Pieces of a text that are folded together.
CHUNK = 256


def chunks(n: Column, size: int = CHUNK) -> Column:
    """0, 1, ... of the chunks that n pieces make, one at least."""
    return F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int"))


def fold(pieces: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """The arrays of kind that step gives for each piece, joined, while it carries state from piece to piece; null for null.

    A fold copies its state at each step, all that it has gathered with it. So pieces are folded in chunks, and only
    the chunks gather everything: the copies grow with pieces times CHUNK and not with the square of pieces.
    """
    none = F.array().cast(kind).alias("found")

    def inner(acc: Column, x: Column) -> Column:
        after, new = step(acc, x)
        return F.struct(*[after[n].alias(n) for n in state], F.concat(acc["found"], new).alias("found"))

    def outer(of: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(of, k * CHUNK + 1, F.lit(CHUNK)), F.struct(*[acc[n].alias(n) for n in state], none), inner)
            return let(part, lambda r: F.struct(*[r[n].alias(n) for n in state], F.concat(acc["found"], r["found"]).alias("found")))

        return one

    def all_of(of: Column) -> Column:
        return F.aggregate(chunks(F.size(of)), F.struct(*[c.alias(n) for n, c in state.items()], none), outer(of), lambda acc: acc["found"])

    return let(pieces, lambda of: F.when(of.isNotNull(), all_of(of)))
