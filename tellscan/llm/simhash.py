"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Fingerprints link when they differ in at most RADIUS bits. Equal fingerprints are one node. Of B blocks of bits, two
fingerprints within the radius agree in B - RADIUS (pigeonhole), so the comparison is exact when it is made inside the
buckets of every choice of so many blocks; B grows with the number of fingerprints, so that buckets stay small. A
bucket is ordered by population count and cut into tiles of about TILE. A fingerprint is dealt only to those pairs of
tiles whose counts come within the radius of its own: others are never formed. In a pair of tiles, numpy XORs blocks
sorted by population count, skips block pairs whose counts differ too much, and counts bits in the rest. A pair
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.llm._util import fresh, parallelism, save
from tellscan.llm.graph import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 2048
BLOCK = 256
MOST_TILES = 8
ROWS_AT_ONCE = 1 << 15


def simhash_bytes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text; 0 when it has no words."""
    words = text.lower().split() if text else []  # on bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), ROWS_AT_ONCE):
        part = h[i : i + ROWS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the unsigned fingerprint held in a signed long; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            fps = [_signed(simhash_bytes(x.as_py(), shingle, seed)) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - radius of the blocks, as signed longs."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def _blocks(n: int, radius: int, tile: int) -> int:
    """The fewest blocks with which a bucket of n even fingerprints has at most MOST_TILES tiles, up to three more than must be."""
    for extra in (1, 2, 3):
        if n <= MOST_TILES * tile << 64 * extra // (radius + extra):
            break
    return radius + extra


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one tile (right is None) or between two."""
    both = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(both), dtype=np.int8)
    if right is not None:
        side[len(left) :] = 1
    order = np.argsort(np.bitwise_count(both), kind="stable")
    x, side = both[order], side[order]
    ones = np.bitwise_count(x).astype(np.int16)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(x), BLOCK):
        a = x[i : i + BLOCK]
        top = ones[min(i + BLOCK, len(x)) - 1] + radius
        for j in range(i, len(x), BLOCK):
            if ones[j] > top:
                break  # counts ascend: every later block differs by more than the radius
            near = np.bitwise_count(a[:, None] ^ x[None, j : j + BLOCK]) <= radius
            r, c = np.nonzero(near)
            r, c = r + i, c + j
            keep = r < c
            if right is not None:
                keep &= side[r] != side[c]
            if keep.any():
                found.append((r[keep], c[keep]))
    if not found:
        return x[:0], x[:0]
    r, c = (np.concatenate(p) for p in zip(*found, strict=True))
    label = np.arange(len(x))
    while True:
        low = label.copy()
        np.minimum.at(low, r, label[c])
        np.minimum.at(low, c, label[r])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(x)))
    return x[moved], x[label[moved]]


def _compare(radius: int):
    keys = ["band", "val", "i", "j"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        if group["i"].iloc[0] == group["j"].iloc[0]:
            a, b = tile_links(fp, None, radius)
        else:
            first = (group["tile"] == group["i"]).to_numpy()
            a, b = tile_links(fp[first], fp[~first], radius)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for f in frames:  # sorted by keys; the last group of a batch may go on in the next
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            k = f[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            out = [one(f.iloc[s:e]) for s, e in zip(edges, edges[1:], strict=False) if e - s > 1]
            held = f.iloc[edges[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held) > 1:
            yield one(held)

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(src, dst): links between different fingerprints, enough to connect each group of linked ones."""
    nodes = fps.select("fp").distinct()
    masks = _masks(radius, blocks or _blocks(nodes.count(), radius, tile))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(m).alias("val")) for k, m in enumerate(masks)])
    rows = nodes.select("fp", F.bit_count("fp").alias("ones"), F.inline(bands))
    cells = rows.groupBy("band", "val", "ones").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("band", "val").orderBy("ones")  # at most 65 rows

    def upto(ones: int) -> Column:
        return F.coalesce(F.sum("n").over(ordered.rangeBetween(Window.unboundedPreceding, ones)), F.lit(0))

    placed = cells.select("band", "val", "ones", "n", upto(-1).alias("at"), F.floor(upto(-radius - 1) / tile).cast("int").alias("low"), F.floor((upto(radius) - 1) / tile).cast("int").alias("high"))
    several = placed.withColumn("size", F.sum("n").over(Window.partitionBy("band", "val"))).where("size > 1")
    tiled = rows.join(several, ["band", "val", "ones"]).withColumn("tile", F.floor((F.col("at") + F.pmod(F.xxhash64("fp"), F.col("n"))) / tile).cast("int"))
    paired = tiled.withColumn("other", F.explode(F.sequence("low", "high"))).select("band", "val", "fp", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    n = parallelism(fps.sparkSession)
    dealt = paired.repartition(n, "band", "val", "i", "j").sortWithinPartitions("band", "val", "i", "j")
    return dealt.mapInPandas(_compare(radius), "src long, dst long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), a row for each row of docs.

    component_id is the smallest doc_id that can be reached over links, the row's own included; root is the smallest
    signed fingerprint of the component. Null texts and texts without words have fingerprint 0 and link like any other.
    Repeated rows and equal doc_ids keep their rows; a null doc_id never becomes a component_id unless all are null.
    """
    fps = save(fingerprints(docs, id_col, text_col), "simhash")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = save(connected_components(links(fps, radius)), "simhash-roots")
    nodes = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    nodes = save(nodes, "simhash-nodes")
    lowest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(nodes.select("fp", "root").join(lowest, "root"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with one row left of each component: that of the smallest doc_id."""
    root, did, th = (fresh(docs, c) for c in ("sim_root", "sim_id", "sim_th"))
    found = components(docs, id_col, text_col, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    names = found.select(F.col("doc_id").alias(did), F.col("text_hash").alias(th), F.col("root").alias(root)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(did)) & (F.xxhash64(docs[text_col]) == F.col(th))
    return docs.join(names, same).dropDuplicates([root]).drop(root, did, th)
