"""Operator 5: repeated byte strings by prefix-free parsing.

A rolling hash over GRAM bytes is the trigger: each string of LENGTH bytes is cut at the place of the least hash in its
first half, a place that depends on the string alone. So a text is parsed at its cuts, and a string is a suffix of the
phrase that ends at its cut (at most half of it) followed by what the parse has next. Strings are equal when the
suffixes are equal in the dictionary of phrases and what follows is equal in the parse.

1. The parse has a row for each cut: the phrase that ends there, what follows, and which strings are cut there. Its key
   stands for the LENGTH / 2 bytes that follow. Keys that occur once can't belong to repeats.
2. The dictionary has each different phrase with what follows once, with the number of its places. One that has several
   places is a repeat in all its strings.
3. Of the keys with different entries, each entry's bytes are fetched once. In a block of such entries the phrases are
   sorted by their suffixes and what follows by its prefixes, two suffix orders with their common prefix lengths;
   joined for each suffix length, they give the classes of equal strings, byte for byte.
4. A key with more than HOT entries goes by the same classes, found for each string by its digest and dealt out by it.

Digests are SHA-256, cut to 128 bits, in 2 and 4. Texts are compressed for the two joins that need them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.llm._util import parallelism, save

LENGTH = 400
GRAM = 8
#: Rows that a block in step 3 has before it is worked on, and the most rows of one key that step 3 takes.
BLOCK, HOT = 16_384, 65_536
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.uint64(0xFFFFFFFF)


def phrase_ends(x: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, first start, last start) for each phrase of a text's bytes: the strings that begin there are cut at end."""
    half, starts = length // 2, len(x) - length + 1
    if starts < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    count = starts + half - 1
    grams = np.ndarray((count,), dtype="<u8", buffer=x, strides=(1,))
    mixed = (grams ^ (grams >> np.uint64(31))) * MIX
    cur = (mixed & ~PLACES) | np.arange(count, dtype=np.uint64)  # a tie goes to the first place
    size = 1
    while 2 * size <= half:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    cut = np.minimum(cur[:starts], cur[half - size : half - size + starts]) & PLACES
    new = np.flatnonzero(cut[1:] != cut[:-1]) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [starts - 1]))
    return cut[first].astype(np.int64), first, last


def _phrases(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = xxhash.xxh3_64_intdigest, hashlib.sha256
        for b in batches:
            ids, hashes, sizes, ends, lows, highs, keys, wholes = [], [], [], [], [], [], [], []

            def pack() -> pa.RecordBatch:
                n = np.array(sizes, dtype=np.int64)
                e, lo, hi = (np.concatenate(v) for v in (ends, lows, highs))
                who = [pa.array(v, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))) for v in (ids, hashes)]
                digests = np.frombuffer(b"".join(wholes), dtype="<i8").reshape(-1, 4)
                hashed = [np.array(keys, dtype=np.uint64).view(np.int64), digests[:, 0].copy(), digests[:, 1].copy()]
                return pa.RecordBatch.from_arrays([*who, *(pa.array(v.astype(np.int32)) for v in (e, e - hi, e - lo)), *map(pa.array, hashed)], ["did", "th", "a", "smin", "smax", "k", "h1", "h2"])

            for did, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                e, lo, hi = phrase_ends(np.frombuffer(raw, dtype=np.uint8), length)
                mv = memoryview(raw)
                keys += [key(mv[i : i + half]) for i in e.tolist()]
                wholes += [sha(mv[i : j + length]).digest() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                for v, x in ((ids, did), (hashes, th), (sizes, len(e)), (ends, e), (lows, lo), (highs, hi)):
                    v.append(x)
                if len(keys) > 200_000:
                    yield pack()
                    for v in (ids, hashes, sizes, ends, lows, highs, keys, wholes):
                        v.clear()
            if keys:
                yield pack()

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = [press.compress(x.as_buffer()) for x in b.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["did", "th", "z"])


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "did", "th", "a", "smin", "smax", "dup", "phrase", "after"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_(), pa.binary(), pa.binary()]
        for b in batches:
            rows = []
            for did, th, z, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = zstandard.decompress(z)
                for q in asked:
                    a, s = q["a"], q["smax"]
                    rows.append((q["k"], did, th, a, q["smin"], s, q["dup"], text[a - s : a], text[a : a + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def _order(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and bytes, and how many bytes each has in common with the one before (-1: another group)."""
    words = np.ascontiguousarray(x).view(">u8")
    order = np.lexsort([*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group])
    s, g = x[order], group[order]
    same = s[1:] == s[:-1]
    common = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
    common[g[1:] != g[:-1]] = -1
    return order, np.concatenate(([-1], common))


def _padded(values: list[bytes], width: int, backwards: bool) -> np.ndarray:
    out = np.zeros((len(values), -(-width // 8) * 8), dtype=np.uint8)
    for i, v in enumerate(values):
        row = np.frombuffer(v, dtype=np.uint8)
        out[i, : len(row)] = row[::-1] if backwards else row
    return out


def repeated_starts(group: np.ndarray, smin: np.ndarray, smax: np.ndarray, dup: np.ndarray, phrase: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """[row, s]: whether the string that begins s bytes before the row's phrase end is there more than once."""
    n, half = len(group), length // 2
    by_phrase, common_suffix = _order(group, _padded(phrase, half, True))
    by_after, common_prefix = _order(group, _padded(after, length, False))
    found = np.zeros((n, half), dtype=bool)
    left, right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    weight = np.where(dup, 2, 1)
    for s in range(int(smin.min()), int(smax.max()) + 1):
        rows = np.flatnonzero((smin <= s) & (s <= smax))
        if len(rows) == 0:
            continue
        left[by_phrase] = np.cumsum(common_suffix < s)
        right[by_after] = np.cumsum(common_prefix < length - s)
        key = left[rows] * (n + 1) + right[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        at = np.cumsum(new) - 1
        total = np.bincount(at, weights=weight[rows][order])
        found[rows[order], s] = total[at] > 1
    return found


def _settle(length: int, block: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in ("k", "did", "th", "a", "smin", "smax", "dup")} | {"did": table.column("did")}
        rep = repeated_starts(np.unique(col["k"], return_inverse=True)[1], col["smin"], col["smax"], col["dup"], table.column("phrase").to_pylist(), table.column("after").to_pylist(), length)
        rep[col["dup"]] = False  # known already
        edge = np.diff(np.pad(rep, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, s0 = np.nonzero(edge == 1)
        s1 = np.nonzero(edge == -1)[1]
        take = pa.array(row)
        a = col["a"][row]
        return pa.RecordBatch.from_arrays([col["did"].combine_chunks().take(take), pa.array(col["th"][row]), pa.array((a - s1 + 1).astype(np.int32)), pa.array((a - s0).astype(np.int32))], ["did", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < block:
                continue
            table = pa.Table.from_batches(held)
            k = table.column("k").to_numpy()
            cut = int(np.flatnonzero(k == k[-1])[0])  # rows of the last key may still come
            if cut:
                yield work(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size -= cut
        if size:
            yield work(pa.Table.from_batches(held))

    return run


def _spelt(length: int):
    """A row for each string of the rows: its place, its digest and whether it is known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                both, n = r["phrase"] + r["after"], len(r["phrase"])
                span = range(r["smin"], r["smax"] + 1)
                digests = np.frombuffer(b"".join(hashlib.sha256(s.to_bytes(4) + both[n - s : n + length - s]).digest() for s in span), dtype="<i8").reshape(-1, 4)
                m = len(span)
                yield pa.RecordBatch.from_arrays([pa.array([r["did"]] * m, pa.int64()), pa.array([r["th"]] * m, pa.int64()), pa.array([r["a"] - s for s in span], pa.int32()), pa.array([r["dup"]] * m), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], ["did", "th", "lo", "dup", "h1", "h2"])

    return run


def _keys(left: DataFrame, did: str = "d", th: str = "t"):
    return left["did"].eqNullSafe(F.col(did)) & (left["th"] == F.col(th))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(did, th, lo, hi): the strings of length bytes that begin at lo to hi of a text also begin elsewhere."""
    if length % 16:
        raise ValueError("length must be a multiple of 16")
    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    parse = rows.mapInArrow(_phrases(length), "did long, th long, a int, smin int, smax int, k long, h1 long, h2 long")
    # written, so that the join with it can be split where a key is frequent
    again = save(parse.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeat-keys")
    some = save(parse.join(again, "k", "left_semi"), "repeat-parse")
    entry = ["k", "h1", "h2", "smin", "smax"]
    dictionary = save(some.groupBy(*entry).agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "a")).alias("one")), "repeat-dictionary")
    wholly = some.join(dictionary.where("n > 1").select(*entry), entry).select("did", "th", (F.col("a") - F.col("smax")).alias("lo"), (F.col("a") - F.col("smin")).alias("hi"))
    mixed = dictionary.groupBy("k").agg(F.count("*").alias("entries")).where("entries > 1")
    asked = dictionary.join(mixed, "k").select(F.col("one.did").alias("d"), F.col("one.th").alias("t"), F.struct(F.col("one.a").alias("a"), "smin", "smax", "k", (F.col("n") > 1).alias("dup")).alias("q"), (F.col("entries") > hot).alias("hot"))
    fetched = "k long, did long, th long, a int, smin int, smax int, dup boolean, phrase binary, after binary"

    def bytes_of(which) -> DataFrame:
        lists = asked.where(which).groupBy("d", "t").agg(F.collect_list("q").alias("asked"))  # a phrase end at most once
        texts = squeezed(docs, id_col, text_col, length)
        return texts.join(lists, _keys(texts)).select("did", "th", "z", "asked").mapInArrow(_fetch(length), fetched)

    n = parallelism(docs.sparkSession)
    partly = bytes_of(~F.col("hot")).repartition(n, "k").sortWithinPartitions("k").mapInArrow(_settle(length, block), "did long, th long, lo int, hi int")
    found = wholly.unionByName(partly)
    if not mixed.where(F.col("entries") > hot).isEmpty():
        spelt = bytes_of(F.col("hot")).mapInArrow(_spelt(length), "did long, th long, lo int, dup boolean, h1 long, h2 long")
        often = spelt.groupBy("h1", "h2").agg(F.sum(F.when(F.col("dup"), 2).otherwise(1)).alias("n")).where("n > 1").select("h1", "h2")
        found = found.unionByName(spelt.where("not dup").join(often, ["h1", "h2"], "left_semi").select("did", "th", "lo", F.col("lo").alias("hi")))
    return found


def squeezed(docs: DataFrame, id_col: str, text_col: str, at_least: int) -> DataFrame:
    """(did, th, z): the compressed texts of at least so many bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where(F.octet_length("text") >= at_least).mapInArrow(_squeezed, "did long, th long, z binary")


def kept(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """The text less the strings that begin in spans, the number of bytes and of runs removed."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    out, at = [], 0
    for s, e in runs:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out), sum(e - s for s, e in runs), len(runs)


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for did, z, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = zstandard.decompress(z.as_buffer())
                left, removed, n = kept(text, [(s["lo"], s["hi"]) for s in spans or ()], length)
                out.append((did, len(text), removed, n, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if with_text else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string()]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, less parts of characters) for every row of docs.

    Every byte goes that a string of length bytes covers which begins anywhere else too, in the same text or another.
    A null text is an empty one. Repeated rows are texts like any other and so repeat each other; null ids are kept.
    """
    spans = repeats(docs, id_col, text_col, length, **options).groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    named = spans.select(F.col("did").alias("d"), F.col("th").alias("t"), "spans")
    texts = squeezed(docs, id_col, text_col, 0)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.join(named, _keys(texts), "left").select("did", "z", "spans").mapInArrow(_cut(length, with_text), schema)


def naive(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 by brute force; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        left = bytes(c for c, g in zip(t, gone[1:], strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out
