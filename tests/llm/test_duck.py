"""Operators 11 and 12 against code of their own: zlib and hashlib, a loop over rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tellscan.llm import fim, resample

SCHEMA = "doc_id long, text string"
HARD = [None, "", " ", "a", "Ab1\n😀 c\x00d", "holds <P> a marker", "x<S>y", "ends <", "<", "S>M>", "l'été, déjà vu", "same text", "same text", "tab\tand\r\nline", "word " * 40, "UPPER lower 123 ünïcödé_x " * 30]


def halves(seed: str, doc_id) -> list[int]:
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def fim_row(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, (h1, h2, h3, h4) = len(units), halves("1", doc_id)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, new, lengths = "plain", text, (None, None)
    else:
        form = "spm" if h4 % 100 < 20 else "psm"
        new = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
        lengths = len(pre), len(mid)
    return doc_id, n, form, *lengths, hashlib.sha256(new.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_equals_a_loop_over_rows(spark):
    rng = random.Random(3)
    rows = list(enumerate(HARD)) + [(i, "".join(rng.choice(["ab", "Z", " ", ".", "é", "\n", "<", "P", ">", "S"]) for _ in range(rng.randrange(60)))) for i in range(100, 400)]
    found = fim.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(fim_row(*r) for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    back = fim.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form")))
    assert all(r.back == (r.text or "") for r in back.collect())


def test_long_texts_go_through_by_themselves(spark):
    rows = [(1, "Lorem ipsum, dolor. " * 500_000), (2, "short one"), (3, "x" * 9_000_000), (4, None)]
    assert sorted(map(tuple, fim.report(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())) == [fim_row(*r) for r in rows]


def test_null_ids_clashing_names_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, "some words here", 7, "kept")], "doc_id long, text string, fim_text int, AT string")
    row = fim.transform(odd).collect()[0]
    assert row.fim_text == 7 and row.AT == "kept" and row.fim_units == 5 and row["_fim_text"]
    assert (row.fim_form, row.fim_prefix_chars) == fim_row("null", "some words here")[2:4]
    assert fim.report(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = fim.report(spark.createDataFrame([(1, "a b c d")] * 2, SCHEMA)).collect()
    assert twice[0] == twice[1]


def features(text, most=2):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(str.maketrans(resample.UPPER, resample.LOWER)).encode())
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def resampled(docs, target, percent=25, least=20, buckets=10_000, most=2):
    count = lambda texts: [zlib.crc32(f) % buckets for t in texts for f in features(t, most)[1]]
    s, t = ([0] * buckets for _ in range(2))
    for b in count(x for _, x in docs):
        s[b] += 1
    for b in count(target):
        t[b] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(ss + buckets) / ((s[b] + 1) * float(tt + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, f = features(text, most)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = halves("7", "null" if doc_id is None else doc_id)[0]
        rows.append((doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {r: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((i, f, w, s, rank.get((i, n, f, w, s))) for i, n, f, w, s in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_resampling_equals_a_loop_over_rows(spark, parts):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma7", "délta", "the", "of"]
    docs = list(enumerate(HARD)) + [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(50)))) for i in range(100, 300)]
    target = [None, "", "alpha beta of the", "délta délta"]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    found = resample.report(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    expected = resampled(docs, target)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert [r[4] for r in expected].count(None) < len(expected) and found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_other_parameters_of_resampling(spark):
    docs = [(i, f"one two three four {'five ' * (i % 7)}") for i in range(60)]
    out = resample.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("two three four",)], "text string"), percent=50, min_words=5, most_words=3, buckets=64, keep_text=True)
    assert sorted(((r.doc_id, r.dsir_features, r.dsir_weight, r.dsir_score, r.dsir_rank) for r in out.collect()), key=repr) == resampled(docs, ["two three four"], 50, 5, 64, 3)
    assert out.columns[:2] == ["doc_id", "text"]


def test_ties_repeats_nulls_and_empty_tables_of_resampling(spark):
    text = "word " * 25
    rows = [(3, text, 1)] * 8 + [(None, text, 2)] * 4
    out = resample.resample(spark.createDataFrame(rows, "doc_id long, text string, DSIR_rank int"), spark.createDataFrame([], "text string"))
    ranks = [r["_dsir_rank"] for r in out.collect() if r["_dsir_rank"]]
    assert sorted(ranks) == [1, 2, 3] and out.count() == 12 and "DSIR_rank" in out.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.report(empty, empty).count() == 0
    assert [r["rank"] for r in resample.report(spark.createDataFrame([(1, "few words")], SCHEMA), empty).collect()] == [None]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    from tellscan.llm.queries import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    found = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


def test_arrays_of_windows_equal_brute_force():
    """Operator 10's tables, whatever the window and the likeness of items; and a pass of many words stays small."""
    from tellscan.llm import decontam

    rng = random.Random(3)
    for _ in range(400):
        words = ["a", "b", "c", "d", "e", "f"][: rng.choice([2, 3, 6])]
        items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 12, 13, 14, 20])))) for i in range(rng.randrange(1, 8))]
        text, window = " ".join(rng.choice([*words, "z"]) for _ in range(rng.randrange(60))), rng.choice([3, 5, 13])
        spans, found = decontam.Search([(a, b.encode()) for a, b in items], window).hits(decontam.words_of(text.encode()))
        want = decontam.naive(text, items, window)
        assert (sum(e - s for s, e in decontam.merged(spans)), sorted(found)) == (want[1], sorted(i for i, t in items if decontam.naive(text, [(i, t)], window)[1])), (items, text, window)
    search = decontam.Search([(str(i), " ".join(f"w{rng.randrange(50_000):x}" for _ in range(1_000)).encode()) for i in range(100)])
    machine = search.machines[0][0]
    assert sum(x.nbytes for x in (machine.shift, machine.first, machine.bucket, machine.starts, machine.lengths)) < 30 << 20
