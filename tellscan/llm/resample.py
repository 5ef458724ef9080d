"""Operator 11: importance resampling towards a target distribution, by DuckDB in each partition.

Runs of one and two words are hashed into buckets, and the documents' and the target's shares of a bucket give its gain.
In each partition DuckDB unnests the words of its rows, forms n-grams by window and takes their buckets by a registered
zlib CRC. The buckets of each row and the counts of each partition are written as Parquet in one pass over the texts;
Spark adds the counts up to gains and means these over the buckets of each row. Noise from a hash of the row's id is
added, and the highest scores are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellscan.llm import duck
from tellscan.llm._util import fresh, save

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest n-gram, number of buckets, percent of the documents with at least MIN_WORDS words that are drawn, seed of the noise.
MOST_WORDS, BUCKETS, PERCENT, MIN_WORDS, SEED = 2, 10_000, 25, 20, 7


def _ngrams(most_words: int, buckets: int) -> str:
    """DuckDB SQL over batch(pos, body): pos, k and bucket of each run of k words, repeats included, row after row."""
    leads = "".join(f", lead(w, {k}) OVER () AS w{k}, lead(pos, {k}) OVER () AS pos{k}" for k in range(1, most_words))
    runs = ["w", *[f"CASE WHEN pos{k} = pos THEN w || {' || '.join(f"' ' || w{j}" for j in range(1, k + 1))} END" for k in range(1, most_words)]]
    return f"""
WITH u AS (SELECT pos, unnest(regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM batch),
n AS (SELECT pos, w{leads} FROM u),
g AS (SELECT pos, unnest({list(range(1, most_words + 1))}) AS k, unnest([{', '.join(runs)}]) AS gram FROM n)
SELECT pos, k, (crc32(gram) % {buckets})::INTEGER AS bucket FROM g WHERE gram IS NOT NULL"""


def spill(docs: DataFrame, text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, keep_text: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, counts, names), written in one pass: the columns of docs with the number of words and the buckets of all runs
    of words, under these names, and (bucket, n) a row for each bucket that a partition has.
    """
    body, words, held, counted = (fresh(docs, c) for c in ("dsir_body", "dsir_words", "dsir_buckets", "dsir_counts"))
    sql = _ngrams(most_words, buckets)
    given = docs.withColumn(body, F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = duck.with_columns(docs.select(*[f"`{c}`" for c in kept]), {words: "long", held: "array<int>", counted: "array<long>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros(buckets, np.int64), None
        for rows in duck.slices(batches, body):
            found = duck.ask(sql, duck.numbered(rows, [body]).rename_columns(["pos", "body"]))
            pos, k, bucket = (found.column(c).to_numpy() for c in ("pos", "k", "bucket"))
            if np.any(pos[1:] < pos[:-1]):
                raise RuntimeError("rows came back in another order")
            sums += np.bincount(bucket, minlength=buckets)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pos, minlength=rows.num_rows))])
            n_words = np.bincount(pos[k == 1], minlength=rows.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            own = [rows.column(rows.schema.get_field_index(c)) for c in kept]
            kinds = [c.type for c in own]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), lists, pa.nulls(rows.num_rows, pa.list_(pa.int64()))], [*kept, words, held, counted])
        if kinds is not None:
            total = [pa.nulls(1, t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*total, pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([sums], pa.list_(pa.int64()))], [*kept, words, held, counted])

    written = save(given.mapInArrow(run, schema), "buckets")
    of_rows, of_parts = F.col(counted).isNull(), F.col(counted).isNotNull()
    counts = written.where(of_parts).select(F.posexplode(counted).alias("bucket", "n")).where("n > 0")
    return written.where(of_rows).drop(counted), counts, [words, held]


def gains(ours: DataFrame, theirs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of counts: 1000 times the log ratio of the smoothed shares that theirs and ours have in it, floored."""
    counts = ours.withColumn("ours", F.lit(True)).unionByName(theirs.withColumn("ours", F.lit(False)))
    of = lambda side: F.coalesce(F.sum(F.when(F.col("ours") == side, F.col("n"))), F.lit(0)).cast("double")
    merged = counts.groupBy("bucket").agg(of(True).alias("s"), of(False).alias("t"))
    total = counts.agg(of(True).alias("s_all"), of(False).alias("t_all"))
    full = ours.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(merged, "bucket", "left").fillna(0.0, ["s", "t"])
    ratio = (F.col("t") + 1.0) * (F.col("s_all") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("t_all") + float(buckets)))
    # one row, of two numbers, beside a row for each bucket
    return full.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(id_: Column, seed: int = SEED) -> Column:
    """A Gumbel draw from a hash of the id, in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(rows: DataFrame, gain: DataFrame, names: list[str], id_col: str = "doc_id", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """rows, as spilled, with dsir_features, dsir_weight and dsir_score in place of their buckets.

    Rows without features have weight 0; the mean is floored towards minus infinity. The gains go to every task:
    `buckets` numbers, however many rows there are.
    """
    table = sorted((r.bucket, r.gain) for r in gain.collect())  # a row for each bucket
    sent = rows.sparkSession.sparkContext.broadcast(np.array([g for _, g in table], np.int64))
    held = names[1]
    features, weight, score_ = (fresh(rows, c) for c in ("dsir_features", "dsir_weight", "dsir_score"))
    kept = [c for c in rows.columns if c != held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(held))
            sums = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            n = np.diff(ends)
            own = [b.column(b.schema.get_field_index(c)) for c in kept]
            # whole numbers throughout: a quotient of doubles could round up to the next one
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array((sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), pa.int64())], [*kept, features, weight])

    out = rows.mapInArrow(run, duck.with_columns(rows.drop(held), {features: "long", weight: "long"}))
    return out.withColumn(score_, F.col(weight) + noise(F.col(id_col), seed))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """The rows of docs (text_col only if keep_text) with dsir_words, dsir_features, dsir_weight, dsir_score and dsir_rank.

    Of the rows with at least min_words words, percent in a hundred (floored) get a rank: by falling score, equal scores
    by rising id, null ids last. Rows equal in both get successive ranks in an order of no meaning. Null texts have no words.
    An empty target leaves the gains to the smoothing, and an empty docs gives no rows.

    Ranks need no sort of all rows: scores are whole numbers in a range that logarithms bound, so a count by score (on the
    driver, a few ten thousand rows at any size) says how many rows lie above each, and ties are numbered score by score.
    The noise spreads rows over some thousand scores, equal texts too.
    """
    rows, ours, names = spill(docs, text_col, most_words, buckets, keep_text)
    _, theirs, _ = spill(target.select(F.col(target_text).alias("text")), "text", most_words, buckets)
    scored = save(score(rows, gains(ours, theirs, buckets), names, id_col, buckets, seed), "scored")
    words, _, _, score_ = scored.columns[-4:]
    rank = fresh(docs, "dsir_rank")
    able = scored.where(F.col(words) >= min_words)
    by_score = sorted(((r[0], r[1]) for r in able.groupBy(score_).count().collect()), reverse=True)
    draws = percent * sum(n for _, n in by_score) // 100
    above, before = [], 0
    for s, n in by_score:
        if before >= draws:
            break
        above.append((s, before))
        before += n
    lowest = above[-1][0] if above else None
    if lowest is None:
        return scored.withColumn(rank, F.lit(None).cast("long"))
    key, offset = fresh(scored, "at_score"), fresh(scored, "n_above")
    offsets = docs.sparkSession.createDataFrame(above, f"`{key}` long, `{offset}` long")
    high = (F.col(words) >= min_words) & (F.col(score_) >= lowest)
    numbered = scored.where(high).join(F.broadcast(offsets), F.col(score_) == F.col(key)).withColumn(rank, F.col(offset) + F.row_number().over(Window.partitionBy(score_).orderBy(F.col(id_col).asc_nulls_last())))
    numbered = numbered.withColumn(rank, F.when(F.col(rank) <= draws, F.col(rank)).cast("long")).drop(key, offset)
    return numbered.unionByName(scored.where(~high).withColumn(rank, F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs."""
    out = resample(docs.select("doc_id", "text"), target)
    return out.select("doc_id", *[F.col(f"dsir_{c}").cast("long").alias("n_features" if c == "features" else c) for c in ("features", "weight", "score", "rank")])


def _crc_table() -> list[int]:
    """The 256 steps of CRC-32 for a byte, from its polynomial."""
    steps = list(range(256))
    for _ in range(8):
        steps = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in steps]
    return steps


ORACLE_SQL = f"""
WITH e AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (
  SELECT regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
df AS (
  SELECT doc_id, g, count(*) AS k FROM (
    SELECT doc_id, unnest(w) AS g FROM e UNION ALL
    SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM e)) GROUP BY ALL),
bf AS (
  SELECT g, count(*) AS k FROM (
    SELECT unnest(w) AS g FROM b UNION ALL
    SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)) GROUP BY ALL),
v AS (SELECT DISTINCT g FROM (SELECT g FROM df UNION ALL SELECT g FROM bf)),
x AS (SELECT g, hex(encode(g)) AS h FROM v),
y AS (SELECT g, list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS z FROM x),
c AS (
  SELECT g, xor(list_reduce(z, lambda a, q: xor(a >> 8, {_crc_table()}[(xor(a, q) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM y),
s AS (SELECT bucket, sum(k)::DOUBLE AS s FROM df JOIN c USING (g) GROUP BY 1),
t AS (SELECT bucket, sum(k)::DOUBLE AS t FROM bf JOIN c USING (g) GROUP BY 1),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS sa, coalesce((SELECT sum(t) FROM t), 0) AS ta),
p AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (sa + {BUCKETS}) / ((coalesce(s, 0) + 1) * (ta + {BUCKETS}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), n),
m AS (SELECT doc_id, sum(k)::BIGINT AS nf, sum(k * gain)::BIGINT AS total FROM df JOIN c USING (g) JOIN p USING (bucket) GROUP BY 1),
r AS (
  SELECT doc_id, coalesce(len(w), 0) AS words, coalesce(nf, 0) AS n_features,
         CASE WHEN coalesce(nf, 0) = 0 THEN 0 ELSE (total - ((total % nf) + nf) % nf) // nf END AS weight,
         floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM e LEFT JOIN m USING (doc_id)),
k AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS able FROM r WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
       CASE WHEN place <= {PERCENT} * able // 100 THEN place END::BIGINT AS rank
FROM r LEFT JOIN k USING (doc_id)
"""
