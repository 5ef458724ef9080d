"""Connected components over an edge table, without gathering links or components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.llm._util import release, save

MAX_ROUNDS = 60
#: Edges of a part of the table that are contracted together.
TOGETHER = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges of a part of the table, as stars round the least node that its own edges reach."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        over: dict = {}

        def least(x):
            while (y := over.get(x, x)) != x:
                over[x] = over.get(y, y)
                x = over[x]
            return x

        for b in held:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (tuple(v.values()) if isinstance(v, dict) else v for v in (x, y))
                for v in (x, y):
                    over.setdefault(v, v)
                x, y = least(x), least(y)
                over[max(x, y)] = min(x, y)
        pairs = [(x, least(x)) for x in over]
        kinds = held[0].schema.types
        columns = []
        for i, kind in enumerate(kinds):
            values = [p[i] for p in pairs if p[0] != p[1]]
            columns.append(pa.array([dict(zip([f.name for f in kind], v, strict=True)) for v in values] if pa.types.is_struct(kind) else values, kind))
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= TOGETHER:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it can reach.

    Each part of the table is first contracted by itself. Then alternating large-star and small-star steps: the number of rounds grows with the logarithm of the size, and no
    step holds the neighbours of a node together (a minimum per node, which is pre-aggregated, is joined to the edges,
    where AQE can split a hub). Every round is written to the shared folder, in place of the last. Nulls and loops are ignored; repeated
    edges count once. An empty input gives an empty result.
    """
    cur = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a != b")
    cur = save(cur.mapInArrow(_contracted, cur.schema).distinct(), "cc")
    before = _state(cur)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        last, cur = cur, save(_small_star(_large_star(cur)), "cc")
        release(last)
        now = _state(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(mixed, 32)), F.sum(mixed.bitwiseAND(0xFFFFFFFF))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
