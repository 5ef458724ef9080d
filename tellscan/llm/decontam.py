"""Operator 10: benchmark decontamination by Wu-Manber search over words.

Every window of WINDOW consecutive words of a benchmark item (or all its words, if fewer) is a pattern. Patterns of
similar length share a machine: a shift table over hashes of blocks of two words tells how far the search may jump, a jump
of 0 leads to the bucket of the patterns that end their first m words in such a block, and a direct comparison confirms.
A machine is arrays of word numbers and of places in them, and is built once in each Python worker.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.llm._util import fresh, save

WINDOW = 13
#: Bytes of benchmark text that one pass holds in a worker; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
#: Words of an item that stay together; longer items are cut, and the parts share all but one word of a window.
PART = 2048
#: Patterns of these lengths share a machine, whose longest jump comes from its shortest pattern.
CLASSES = ((1, 1), (2, 4), (5, 8), (9, WINDOW - 1))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: contaminated: n_hit > 0 and ONE_IN * n_hit >= n_words
ONE_IN = 20


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def _blocks(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Hash values of blocks of two word numbers."""
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


class Machine:
    """Wu-Manber tables for windows of about equal length: places in one array of word numbers, all above 0.

    shift has, by the hash of a block, how far a search may jump when it stands on that block; where that is 0, the
    windows whose first m words end in a block of that hash are among bucket[first[h] : first[h + 1]], h being its upper bits.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.m = m = int(lengths.min())
        self.raw, self.two = words.tobytes(), m > 1
        most = int(8 * len(starts) * m).bit_length()
        self.bits, self.bucket_bits = max(10, min(24, most)), max(10, min(20, most))
        self.shift = np.full(1 << self.bits, m - self.two, np.uint8)
        for end in range(1 + self.two, m + 1):  # later ends are nearer to the last word, so theirs stay
            self.shift[self._key(words, starts + end - 1)] = m - end
        key = self._key(words, starts + m - 1) >> (self.bits - self.bucket_bits)
        self.bucket = np.argsort(key, kind="stable").astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << self.bucket_bits))]).astype(np.int32)
        self.starts, self.lengths = starts, lengths

    def _key(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _blocks(words[at - 1] if self.two else np.zeros(len(at), words.dtype), words[at], self.bits)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, length, number of the window) of every occurrence, from left to right."""
        n, m = len(ids), self.m
        if n < m:
            return
        keys = self._key(ids, np.arange(self.two, n))
        # a block with a word that no window has lets the search jump as far as any
        jump = np.where(ids[self.two :] == 0, m, self.shift[keys])
        jumps, raw, at = ([1] * self.two) + jump.tolist(), ids.tobytes(), m - 1
        while at < n:
            if jumps[at]:
                at += jumps[at]
                continue
            key, start = keys[at - self.two] >> (self.bits - self.bucket_bits), at - m + 1
            for w in self.bucket[self.first[key] : self.first[key + 1]].tolist():
                s, size = int(self.starts[w]), int(self.lengths[w])
                if raw[4 * start : 4 * (start + size)] == self.raw[4 * s : 4 * (s + size)]:
                    yield start, size, w
            at += 1


class Search:
    """All windows of a set of items, as places in one array; equal windows are one, with the items that have it."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        held, starts, lengths, owners = array("i"), [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                n = max(1, len(ids) - window + 1)
                starts.append(np.arange(len(held), len(held) + n, dtype=np.int32))
                lengths.append(np.full(n, min(len(ids), window), np.uint8))
                owners.append(np.full(n, number[item], np.int32))
                held.extend(ids)
        words = np.array(held, np.int32)
        self.machines: list[tuple[Machine, np.ndarray, np.ndarray]] = []
        if not starts:
            return
        start, length, owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners)
        for a, b in [*[(a, min(b, window - 1)) for a, b in CLASSES if a < window], (window, window)]:
            of = (length >= a) & (length <= b)
            if of.any():
                self.machines.append(self._machine(words, start[of], length[of], owner[of]))

    @staticmethod
    def _machine(words: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray) -> tuple[Machine, np.ndarray, np.ndarray]:
        """A machine for the different windows, and their owners: owners[ends[w] : ends[w + 1]] has those of window w."""
        digest = np.zeros(len(start), np.uint64)
        padded = np.concatenate([words, np.zeros(int(length.max()), np.int32)])
        for k in range(int(length.max())):
            digest = digest * np.uint64(0x100000001B3) + np.where(k < length, padded[start + k], 0).astype(np.uint64)
        order = np.lexsort((start, length, digest))
        start, length, owner, digest = start[order], length[order], owner[order], digest[order]
        # a window is the one before it if all their words are the same; windows of one digest that differ stay apart
        same = np.concatenate([[False], (digest[1:] == digest[:-1]) & (length[1:] == length[:-1])])
        for k in range(int(length.max())):
            same[1:] &= (k >= length[1:]) | (padded[start[1:] + k] == padded[start[:-1] + k])
        heads = np.flatnonzero(~same)
        return Machine(words, start[heads], length[heads]), owner, np.append(heads, len(start))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words inside occurrences, and the items with occurrences."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        spans, found, seen = [], set(), set()
        for k, (machine, owners, ends) in enumerate(self.machines):
            for start, size, w in machine.find(ids):
                spans.append((start, start + size))
                if (k, w) not in seen:
                    seen.add((k, w))
                    found.update(owners[ends[w] : ends[w + 1]].tolist())
        return spans, {self.names[o] for o in found}


_LAST: dict[str, tuple[object, Search]] = {}


def _search(key: object, items: list[tuple[str, bytes]], window: int) -> Search:
    """The search of a pass, built once in each Python worker; only the last one stays."""
    if "it" not in _LAST or _LAST["it"][0] != key:
        _LAST.clear()
        _LAST["it"] = key, Search(items, window)
    return _LAST["it"][1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _dealt(benchmark: DataFrame, item_col: str, item_text: str, window: int, pass_bytes: int) -> tuple[DataFrame, int]:
    """(item, body, pass) for parts of at most PART + window - 1 words, and the number of passes, none beyond pass_bytes.

    A pass of one part alone may be larger, where its words are.
    """
    words = F.regexp_extract_all(F.col(item_text).cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    found = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(PART))
    parts = found.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, PART + window - 1), " "))).alias("body")).distinct()
    size = F.octet_length("body")
    total = parts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    while True:
        dealt = parts.withColumn("pass", F.pmod(F.xxhash64("item", "body"), F.lit(passes)))
        if passes == 1 or not total:
            return dealt, passes
        # a row for each pass that holds too much; where parts are many, a few more passes even them out
        over = dealt.groupBy("pass").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > pass_bytes) & (F.col("n") > 1))
        if over.isEmpty():
            return dealt, passes
        passes += 1 + passes // 2


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep_text: bool = False) -> DataFrame:
    """The columns of docs (text_col only if keep_text) with n_words, hit_spans and hit_items.

    hit_spans holds [start, end, start, end ...) in words, merged and ascending; hit_items the item ids as strings,
    sorted. Null texts, and texts and items without words, hit nothing; a null item id is the string "null"; repeated
    rows count as they stand, repeated items once. The benchmark goes to the workers in passes of at most pass_bytes;
    with several passes the findings are written between them.
    """
    spark = docs.sparkSession
    bench, passes = _dealt(benchmark, item_col, item_text, window, pass_bytes)
    n_words, spans, items = fresh(docs, "n_words"), fresh(docs, "hit_spans"), fresh(docs, "hit_items")
    out = docs.withColumns({n_words: F.lit(None).cast("long"), spans: F.array().cast("array<int>"), items: F.array().cast("array<string>")})
    names, types = out.columns, out.schema
    at = {c: names.index(c) for c in (text_col, n_words, spans, items)}
    for k in range(passes):
        held = spark.sparkContext.broadcast([(r.item, r.body.encode()) for r in bench.where(F.col("pass") == k).toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], held=held, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            search = _search((key, window), held.value, window)
            for b in batches:
                counts, new_spans, new_items = [], [], []
                old_spans, old_items = b.column(at[spans]).to_pylist(), b.column(at[items]).to_pylist()
                for x, s, i in zip(b.column(at[text_col]).cast(pa.large_binary()), old_spans, old_items, strict=True):
                    words = words_of(x.as_py())
                    found, which = search.hits(words)
                    if s:
                        found += zip(s[::2], s[1::2], strict=True)
                    counts.append(len(words))
                    new_spans.append([v for span in merged(found) for v in span])
                    new_items.append(sorted(which.union(i)))
                columns = list(b.columns)
                columns[at[n_words]] = pa.array(counts, pa.int64())
                columns[at[spans]] = pa.array(new_spans, pa.list_(pa.int32()))
                columns[at[items]] = pa.array(new_items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

        out = out.mapInArrow(run, types)
        if k + 1 < passes:
            out = save(out, "decontam")
    return out if keep_text else out.drop(text_col)


def n_hit(spans: str = "hit_spans"):
    """Words inside spans."""
    signed = F.transform(spans, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, v: a + v)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (columns doc_id and text)."""
    out = scan(docs.select("doc_id", "text"), benchmark, **options).withColumn("n_hit", n_hit())
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), _contaminated("n_hit", "n_words").alias("contaminated"))


def _contaminated(hit: str, words: str):
    return (F.col(hit) > 0) & (ONE_IN * F.col(hit) >= F.col(words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated."""
    n_words, spans, items, hit = (fresh(docs, c) for c in ("n_words", "hit_spans", "hit_items", "n_hit"))
    out = scan(docs, benchmark, text_col=text_col, keep_text=True, **options).withColumn(hit, n_hit(spans))
    return out.where(~_contaminated(hit, n_words)).drop(n_words, spans, items, hit)


def naive(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated by brute force; for tests."""
    words, hit, found = words_of(text.encode() if text else None), set(), set()
    for item, body in items:
        w = words_of(body.encode() if body else None)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for s in range(len(words) - len(p) + 1):
                if words[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    found.add(item)
    joined = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and ONE_IN * len(hit) >= len(words)
