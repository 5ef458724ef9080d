"""Operator 4: canonical exact digests.

The canonical form of a text is its NFKC normalisation, case-folded, with each run of white space made one blank and
none at the ends. The fingerprint is the xxh3-128 digest of that form. Inside a bucket of equal digests the canonical
bytes are compared; where they should differ, the fingerprint carries the rank of its form in the bucket as a suffix,
so that equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.llm._util import parallelism, save

#: Ranges of doc_id for each shuffle partition: with more, ranges of uneven sizes even out.
RANGES = 4
MOST_RANGES = 2048
#: Rows of a bucket of equal digests are compared in so many groups first, then between groups.
SALTS = 32


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points of text replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, following: str, make: Callable[[str], str]) -> tuple:
    new = edited(text, following)
    own, changed, after = canonical(text), canonical(new), canonical(following)
    # equal digests are trusted only with equal canonical texts
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), make(own), make(changed), float(own == changed), float(own == after), hashlib.sha256(text.encode()).hexdigest()


FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "text_sha256": pa.string()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_sha256 string"


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """At most ranges - 1 ids that cut all ids into ranges of about equal size."""
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)]), F.lit(max(10_000, 20 * ranges))).alias("c")).first()[0] if ranges > 1 else []
    return sorted(set(cuts or []))


def report(docs: DataFrame, make: Callable[[str], str] = digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The next document is the one of the next lower doc_id, after the last comes the first; rows of one doc_id follow
    each other by descending text, and null ids come last. A null text is an empty one. A table of one row is its own
    next; an empty table gives an empty result. A likeness is 1 when the canonical texts are equal and 0 when not.

    Ids are cut into ranges; a row of the lowest place of a range needs the first row of the range below, so the first
    rows of all ranges, found from ids alone, are also sent to the range above. Texts move once.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = _bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), min(RANGES * n, MOST_RANGES))
    place = F.lit(0)
    if bounds:
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if len(bounds) < 16 else _search("doc_id", bounds)
    # range 0 is for null ids, the lowest place of all
    in_range = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place + 1).cast("int")
    tops = {r.rng: r.top for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy(in_range.alias("rng")).agg(F.max("doc_id").alias("top")).collect()}  # a row for each range
    if not tops:
        return rows.mapInArrow(lambda batches: iter(()), SCHEMA).drop("text_sha256")
    order = sorted(tops)
    above = {rng: order[(i + 1) % len(order)] for i, rng in enumerate(order)}  # the highest wraps round to the lowest
    to_above = F.create_map(*[F.lit(v) for pair in above.items() for v in pair])
    top_of = F.create_map(*[F.lit(v).cast("long") for rng, top in tops.items() if top is not None for v in (rng, top)]) if any(v is not None for v in tops.values()) else None
    placed = rows.withColumn("rng", in_range)
    first = F.col("doc_id").isNull() if top_of is None else F.when(F.col("rng") == 0, F.lit(True)).otherwise(F.col("doc_id") == F.element_at(top_of, F.col("rng").cast("long")))
    # of the null ids only the row of the highest text is needed above; the others are harmless there
    copies = F.when(first, F.array(F.struct(F.col("rng"), F.lit(False).alias("tail")), F.struct(F.element_at(to_above, F.col("rng")).alias("rng"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("rng"), F.lit(False).alias("tail"))))
    dealt = placed.select("doc_id", "text", F.inline(copies).alias("to", "tail")).repartition(n, "to").sortWithinPartitions("to", "tail", F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (range, doc_id, text) of the row whose next one is still to come

        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(FIELDS.values())], list(FIELDS))

        for b in batches:
            out = []
            for doc_id, text, to, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting and waiting[0] == to:
                    out.append(_row(waiting[1], waiting[2], text, make))
                waiting = None if tail else (to, doc_id, text)
            if out:
                yield pack(out)

    found = save(dealt.mapInArrow(run, SCHEMA), "fingerprints")
    return _told_apart(found, rows, make).drop("text_sha256")


def _search(col: str, bounds: list[int]):
    """The number of bounds below col, by halving."""

    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) > F.lit(bounds[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(bounds))


def _differs(make: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for b in batches:
            out = []
            for key, canon in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != at:
                    at, first = key, canon
                    out.append((key, canon))
                elif canon != first:
                    out.append((key, canon))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["key", "canon"])

    return run


def _told_apart(found: DataFrame, rows: DataFrame, make: Callable[[str], str]) -> DataFrame:
    """found, with suffixes where one digest stands for several canonical texts."""
    shared = found.groupBy("fingerprint").agg(F.min("text_sha256").alias("a"), F.max("text_sha256").alias("b")).where("a != b").select("fingerprint")
    # written first: where it is small, its size is known and the texts aren't dealt out for the join
    shared = save(shared, "shared-fingerprints")
    # only digests shared by different texts need a look at the bytes; equal texts can't differ in canonical form
    forms = rows.mapInArrow(_forms(make), "fingerprint string, canon string")
    suspects = forms.join(shared, "fingerprint", "left_semi").withColumn("salt", F.pmod(F.xxhash64("canon", F.monotonically_increasing_id()), F.lit(SALTS)))
    n = parallelism(rows.sparkSession)
    keyed = suspects.select(F.col("fingerprint").alias("key"), "canon", "salt")
    some = keyed.repartition(n, "key", "salt").sortWithinPartitions("key", "salt").select("key", "canon").mapInArrow(_differs(make), "key string, canon string")
    heads = some.repartition(n, "key").sortWithinPartitions("key", "canon").mapInArrow(_differs(make), "key string, canon string")
    clashes = save(heads.distinct().groupBy("key").agg(F.array_sort(F.collect_set("canon")).alias("forms")).where(F.size("forms") > 1), "clashes")
    if clashes.isEmpty():
        return found
    ranks = clashes.select("key", F.posexplode("forms").alias("rank", "canon"))
    named = rows.mapInArrow(_forms(make, True), "fingerprint string, canon string, text_sha256 string")
    tags = named.join(ranks, [named.fingerprint == ranks.key, named.canon == ranks.canon]).select(named.text_sha256, F.concat("key", F.lit("-"), "rank").alias("tagged")).distinct()
    told = found.join(tags, "text_sha256", "left").withColumn("fingerprint", F.coalesce("tagged", "fingerprint"))
    return told.withColumn("edited_fingerprint", F.when(F.col("near_edited") == 1, F.col("fingerprint")).otherwise(F.col("edited_fingerprint"))).select(*FIELDS)


def _forms(make: Callable[[str], str], with_sha: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            canons = [canonical(t) for t in texts]
            cols = [pa.array([make(c) for c in canons], pa.string()), pa.array(canons, pa.string())]
            if with_sha:
                cols.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["fingerprint", "canon", "text_sha256"][: len(cols)])

    return run


def naive(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """report()'s rows by brute force, for ids that don't repeat; for tests."""
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    return [_row(i, t, order[(k + 1) % len(order)][1], digest)[:7] for k, (i, t) in enumerate(order)]
