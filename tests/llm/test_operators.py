import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tellscan.llm import chat, decontam, fingerprint, langid, licenses, linededup, mixing, passages, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _1 string"


def frame(spark, rows):
    """Documents with two columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, words(rng, rng.randrange(1, 120)), f"s{i % 3}") for i in range(40)]
    shared = words(rng, 60)
    out += [(50, out[3][1], None), (51, f"{words(rng, 9)} {shared}", "s0"), (52, f"{shared} {words(rng, 30)}", "s1")]
    out += [(60, None, "s1"), (61, "", "s2"), (62, "!!! 12 ---", "s2"), (63, "ÀB ﬁn  x", "s0"), (64, "àb fin x", "s0"), (65, "\n\n", "s0")]
    return out


def test_fingerprints_match_brute_force(spark, rows):
    got = sorted(map(tuple, fingerprint.report(frame(spark, rows)).collect()))
    assert got == sorted(fingerprint.naive([(i, t) for i, t, _ in rows]))
    by_id = {g[0]: g[3] for g in got}
    assert by_id[63] == by_id[64] and by_id[50] == by_id[3] and by_id[60] == by_id[61]


def test_clashing_digests_are_told_apart(spark):
    got = fingerprint.report(frame(spark, [(i, t, "s") for i, t in enumerate(["aa", "bb", "aa", "A a"])]), lambda c: "same").collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[2] and len(set(prints.values())) == 3


def test_simhash_matches_brute_force(spark, rows):
    fps = {i: simhash.simhash_bytes(t.encode() if t else None) for i, t, _ in rows}
    group = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            group[i] = min(group[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.components(frame(spark, rows)).collect()}
    assert got == {i: (fps[i], group[i]) for i in fps}
    kept = simhash.near_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_tiles_of_one_bucket_find_the_same_links(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = spark.createDataFrame([(base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)),) for _ in range(80)], "fp long")
    whole, tiled = (simhash.connected_components(simhash.links(fps, tile=t)).groupBy("root").count().count() for t in (2048, 7))
    assert whole == tiled == 1


def test_repeats_match_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(8)]
    texts = [(i, "".join(rng.choice(base)[: rng.randrange(10, 30)] for _ in range(rng.randrange(12)))) for i in range(30)] + [(40, "a" * 200), (41, None), (42, "é" * 40)]
    want = sorted((i, *x) for (i, _), x in zip(texts, suffixes.naive([(t or "").encode() for _, t in texts], 32), strict=True))
    for options in ({}, {"hot": 2}, {"block": 3}):
        got = suffixes.remove_repeats(frame(spark, [(i, t, "s") for i, t in texts]), length=32, **options).collect()
        assert sorted(map(tuple, got)) == want


def test_decontamination_matches_brute_force(spark, rows):
    rng = random.Random(3)
    bench = [(1, rows[5][1]), (2, "W1X w2x"), (3, None), (4, "..."), (10, words(rng, 20)), (None, "w3x")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    named = [("null" if i is None else str(i), t) for i, t in bench]
    for size in (1 << 20, 40):
        got = {r[0]: tuple(r)[1:] for r in decontam.report(frame(spark, rows), items, pass_bytes=size).collect()}
        assert got == {i: decontam.naive(t, named) for i, t, _ in rows}
    kept = decontam.decontaminate(frame(spark, rows), items)
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g[-1]} and kept.columns == frame(spark, rows).columns


def test_language_profiles(spark, rows):
    texts = [(i, t, "x") for i, t, _ in rows] + [(100 + i, "la maison est sur la route avec le chat", "y") for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    known = langid.profiles(docs)
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    for i, t, _ in texts:
        lang, score = langid.naive(t, known)
        assert (got[i].lang_pred, round(got[i].score, 9), got[i].held_out) == (lang, round(score, 9), langid.is_held_out(i))
    assert got[60].lang_pred == got[62].lang_pred == "und"
    assert {60, 61, 62, 65}.isdisjoint(r.doc_id for r in langid.keep(docs).collect())


def test_line_chunks(spark):
    block = "\n".join(f"line {k} of a block" for k in range(12))
    texts = [(1, "top\n" + block + "\nend"), (2, "other\nstart\n" + block), (3, None), (4, ""), (5, "one line"), (5, "one line")]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, [(*t, "s") for t in texts])).collect()}
    assert got[1].text == texts[0][1] and got[3].text is None and got[4].text == ""
    assert got[2].n_removed >= 2 and len(got[2].text) < len(texts[1][1]) and got[2].text.startswith("other\nstart")
    assert got[2].n_lines == 14 and got[5].n_removed == 0


def test_repeated_runs_go_whole(spark):
    rng = random.Random(8)
    block = [f"line {k} of a block" for k in range(40)]
    texts = [(1, "\n".join(block)), (2, "\n".join(["own", *block, "end"])), (3, "\n".join(["x", *block[7:11], "y", block[20], "z"])), (4, "alone"), (5, "alone"), (5, "alone"), (6, None), (7, ""), (None, "q\nr"), (8, "q\nr\nq\nr")]
    texts += [(i, "\n".join(f"l{rng.randrange(6)}" for _ in range(rng.randrange(1, 9)))) for i in range(10, 60)]
    seen, expected = set(), {}
    for i, t in sorted({t for t in texts if t[1] is not None}, key=lambda t: (t[0] is not None, t[0])):
        lines, out = t.split("\n"), set()
        for s in range(max(len(lines) - 1, 1)):
            piece = tuple(lines[s : s + 2])
            out |= set(range(s, min(s + 2, len(lines)))) if piece in seen else set()
            seen.add(piece)
        expected[i] = ("\n".join(x for k, x in enumerate(lines) if k not in out), len(out))
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_runs(frame(spark, [(*t, "s") for t in texts])).collect()}
    assert got.pop(6) == (None, 0) and got == expected
    assert expected[2] == ("own\nend", 40) and expected[3][0] == f"x\ny\n{block[20]}\nz" and expected[5][0] == ""
    assert {r.doc_id: r.text for r in linededup.line_dedup(frame(spark, [(*t, "s") for t in texts])).collect()} == {i: x for i, (x, _) in expected.items()} | {6: None}


def spelt_shingles(text):
    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(found[i : i + 5]) for i in range(len(found) - 4)]


def spelt_pairs(texts):
    """Pairs of documents with passages of 46 shingles that are alike, on words, without the operator's code."""
    of = {i: spelt_shingles(t) for i, t in texts}
    sets = {i: [frozenset(x[k : k + 46]) for k in range(len(x) - 45)] for i, x in of.items()}
    out = set()
    for i, j in itertools.combinations(sorted(sets), 2):
        if set(of[i]) & set(of[j]) and any(5 * len(a & b) >= 4 * len(a | b) for a in sets[i] for b in sets[j]):
            out.add((i, j))
    return out


def groups_of(pairs):
    root = {x: x for pair in pairs for x in pair}
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_passages_match_brute_force(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    got = passages.near_passages(frame(spark, rows)).collect()
    true = spelt_pairs([(i, t) for i, t, _ in rows])
    pairs = {(min(r.doc_id, r.match_doc_id), max(r.doc_id, r.match_doc_id)) for r in got}
    assert pairs <= true and (51, 52) in pairs
    assert {r.doc_id: r.class_id for r in got} == groups_of(true)


def altered(rng, passage, at):
    return [f"alt{rng.randrange(10**6)}" if k in at else w for k, w in enumerate(passage)]


def test_near_passages_inside_longer_texts_are_found(spark):
    """Recall for each length and number of altered words, held against passages spelt out."""
    rng, texts, kinds = random.Random(17), [], {}
    for kind in ((50, 0), (50, 1), (55, 1), (60, 1), (100, 2)):
        for _ in range(40):
            passage, i = words(rng, kind[0], 10**6).split(), len(texts)
            at = rng.sample(range(kind[0]), kind[1])
            for body in (passage, altered(rng, passage, at)):
                texts.append((len(texts), " ".join([words(rng, 60, 10**6), *body, words(rng, 60, 10**6)])))
            kinds[i, i + 1] = kind
    true = spelt_pairs(texts)
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_passages(frame(spark, [(*t, "s") for t in texts])).collect()}
    assert {(min(p), max(p)) for p in got} <= true <= set(kinds)
    for kind in set(kinds.values()):
        due = [p for p in true if kinds[p] == kind]
        assert len(due) >= 30 and sum(p in got for p in due) >= 0.9 * len(due), kind


@pytest.mark.parametrize("options", [{}, {"block": 2, "most": 2}])
def test_variants_of_a_passage_share_a_class(spark, options):
    rng, texts = random.Random(29), []
    for g in range(12):
        passage = words(rng, 58, 10**6).split()
        for v in range(6):
            at = rng.sample(range(58), 1)
            texts.append((10 * g + v, " ".join([words(rng, 20, 10**6), *altered(rng, passage, at), words(rng, 20, 10**6)])))
    texts += [(1000 + k, texts[3][1]) for k in range(3)] + [(1010, texts[3][1]), (1010, texts[3][1])]
    true = spelt_pairs(texts)
    got = {r.doc_id: r.class_id for r in passages.near_passages(frame(spark, [(*t, "s") for t in texts]), **options).collect()}
    root = groups_of(true)
    assert all(root[i] == root[c] for i, c in got.items()) and {got[1000], got[1001], got[1010]} == {got[3]}
    # signatures of one pair in about 150 don't meet; every other pair must be in one class
    assert sum(i in got and got[i] == got.get(j) for i, j in true) >= 0.98 * len(true)


def test_repeats_inside_one_text_and_links_over_them(spark):
    rng = random.Random(31)
    passage = words(rng, 50, 10**6).split()
    twice = " ".join([*passage, words(rng, 20, 10**6), *passage])
    texts = [(1, twice), (2, " ".join([words(rng, 30, 10**6), *altered(rng, passage, [0])])), (3, words(rng, 40) + " " + " ".join(["x y z u v"] * 60)), (4, " ".join(["x y z u v"] * 80)), (5, None), (6, " ".join(passage[:49]))]
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_passages(frame(spark, [(*t, "s") for t in texts])).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert passages.near_passages(frame(spark, [(1, twice, "s")])).count() == 0


def test_every_place_of_a_meeting_is_verified():
    rng, of, span = random.Random(11), passages.Shingles(), passages.SPAN
    for case in range(60):
        middle = words(rng, 50, 40 if case % 3 else 3).split()
        changed = middle[:25] + ["altered"] * (case % 2) + middle[25 + case % 2 :]
        a, r = (of(" ".join([words(rng, 60), *m, words(rng, 60)]).encode()) for m in (middle, changed))
        n = len(a) - span + 1
        each = [passages.likeness(a[i : i + span], r[i : i + span]) for i in range(n)]
        true = [i for i in range(n) if each[i] >= passages.LIKENESS]
        found = passages.verified(a, r, [(0, n - 1, 5, 0, n - 1, 5)])
        assert (true or not case % 3) and all(any(s <= i and i + span <= e for s, e, *_ in found) for i in true)
        assert passages.likenesses(a, r).tolist() == each == passages._slid(a, r, span).tolist()


def test_passages_that_meet_are_found_whatever_their_distance():
    """A word left out or put in moves what follows: the passages that are alike may stand beside those aligned by the least hash."""
    rng, of, span = random.Random(9), passages.Shingles(), passages.SPAN
    due = found = 0
    for case in range(150):
        body = words(rng, 50, 10**6).split()
        at = rng.randrange(15, 35)
        other = body[:at] + body[at + 1 :] if case % 3 else [*body[:at], "new", *body[at:]]
        texts = [" ".join([words(rng, before, 10**6), *m, words(rng, 60 - before, 10**6)]) for m, before in ((body, 30), (other, 20))]
        windows = []
        for h in map(of, (t.encode() for t in texts)):
            _, k, key, lo, hi, c = passages.windows(h)
            *_, both, place = passages.meetings(np.zeros(len(k), dtype=int), key.view(np.int64), passages.packed(lo, hi, c, span, k))
            windows.append((h, both, *passages.unpacked(place, span)[:3]))
        (a, x, *mine), (r, y, *theirs) = windows
        asked = [(*(v[i] for v in mine), *(v[j] for v in theirs)) for i in range(len(x)) for j in np.flatnonzero(y == x[i])]
        got = passages.verified(a, r, asked)
        assert all(p >= passages.LIKENESS for *_, p in got)
        if asked and spelt_pairs(list(enumerate(texts))):
            due, found = due + 1, found + bool(got)
    assert due >= 140 and found == due


def test_windows_of_a_frequent_line_make_no_pairs_unless_they_are_alike():
    """Candidates of a hot signature follow the pairs that are alike, not the square of its windows."""
    rng, of, span, hs = random.Random(41), passages.Shingles(), passages.SPAN, []
    line = words(rng, 20, 10**6)
    for _ in range(150):
        around = [words(rng, 15, 10**6), words(rng, 15, 10**6)]
        hs.append(of(f"{around[0]} {line} {around[1]}".encode()))
    for k in range(0, 10, 2):  # five pairs with one word changed
        near = words(rng, 51, 10**6).split()
        hs[k], hs[k + 1] = of(" ".join(near).encode()), of(" ".join(altered(rng, near, [0])).encode())
    n, zero = len(hs), np.zeros(1, dtype=np.int64)
    p = [passages.packed(zero, zero + len(h) - span, zero + len(h) - span, span)[0] for h in hs]
    t = pa.array(np.arange(n), pa.int64())
    cols = [pa.array([7] * n, pa.int64()), *(pa.array([0] * n, pa.int32()) for _ in range(3)), t, pa.array([0] * n, pa.int32()), pa.array(p, pa.int64()), t, pa.array([h.tobytes() for h in hs], pa.binary())]
    rows = pa.RecordBatch.from_arrays(cols, ["key", "x", "y", "tile", "t", "u", "p", "root", "hs"])
    got = {(a, r) for b in passages._across(span, passages.LIKENESS)(iter([rows])) for a, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
    true = {(j, i) for i in range(n) for j in range(i + 1, n) if any(passages.likeness(hs[i][x : x + span], hs[j][y : y + span]) >= passages.LIKENESS for x in range(len(hs[i]) - span + 1) for y in range(len(hs[j]) - span + 1))}
    assert got == true == {(k + 1, k) for k in range(0, 10, 2)}


def test_signatures_meet_at_the_least_likeness():
    rng, of, span = random.Random(23), passages.Shingles(), passages.SPAN
    met = true = 0
    for _ in range(600):
        base = words(rng, 50, 10**6).split()
        a, r = (of(" ".join([words(rng, 60, 10**6), *m, words(rng, 60, 10**6)]).encode()) for m in (base, altered(rng, base, [25])))
        held = []
        for h in (a, r):
            _, k, key, lo, hi, c = passages.windows(h)
            *_, both, place = passages.meetings(np.zeros(len(k), dtype=int), key.view(np.int64), passages.packed(lo, hi, c, span, k))
            first, last, *_ = passages.unpacked(place, span)
            held.append(set(both[(first <= 60) & (60 <= last)].tolist()))
        met, true = met + bool(held[0] & held[1]), true + 1
    assert met >= 0.98 * true


def test_windows_are_the_intervals_of_equal_least_places():
    rng, of, span = random.Random(37), passages.Shingles(), passages.SPAN
    texts = [words(rng, n, size).encode() for n, size in ((300, 30), (20, 9), (300, 10**6), (0, 1), (49, 5), (50, 5))]
    whole = passages.windows(*of.together(texts))
    for number, body in enumerate(texts):
        h = of(body)
        _, k, key, lo, hi, c = passages.windows(h)
        assert all((x[whole[0] == number] == y).all() for x, y in zip(whole[1:], (k, key, lo, hi, c), strict=True))
        back = passages.unpacked(passages.packed(lo, hi, c, span, k), span)
        assert all((x == y).all() for x, y in zip(back, (lo, hi, c, k), strict=True))
        for seed in range(len(passages.SEEDS)):
            at = passages.least(h, passages.SEEDS[seed], span)
            covered = [i for f, x, y, p in zip(k, lo, hi, c, strict=True) if f == seed for i in range(x, y + 1) if at[i] == p]
            firsts = {h[i : i + span].tobytes(): i for i in reversed(range(len(h) - span + 1))}
            assert covered == sorted(firsts.values())


def test_chat(spark):
    turns = [("user", "hi"), ("assistant", "<|im_end|>"), ("user", None), ("assistant", "bye")]
    log = [(c, k, *turns[k]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for k in range(n)] + [(5, 0, "user", "other"), (None, None, None, None)]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(log, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 5, None} and got[2].copies == 2 and got[2].n_turns == 4
    assert got[2].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n")
    long = spark.createDataFrame([(1, k, "user", str(k)) for k in range(10)] + [(2, k, "user", str(k)) for k in range(7)], "conv_id long, turn long, role string, text string")
    parts = sorted((r.conv_id, r.part, r.rendered.count("im_start")) for r in chat.collapse(long, segment=4).collect())
    assert parts == [(1, 0, 4), (1, 1, 4), (1, 2, 2)]


def test_licenses(spark):
    wrapped = licenses.SENTENCES["mit-grant"].replace("documentation ", "documentation\n") + "\n\n" + licenses.SENTENCES["mit-condition"] + "\n" + licenses.SENTENCES["mit-warranty"]
    texts = [(1, "Bla | bla\nReleased under the MIT License."), (2, wrapped), (3, None), (4, "the mit license"), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: (r.license, r.licenses) for r in licenses.scan(frame(spark, [(*t, "s") for t in texts])).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", "MIT"), 3: (None, ""), 4: (None, ""), 5: ("Apache-2.0", "Apache-2.0 CC-BY-NC-4.0")}


def test_mixing_meets_weights_and_limits(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, 20), "big" if i % 10 else "small") for i in range(1000)] + [(2000, None, None), (2001, "", "none")]
    got = mixing.draws(frame(spark, docs), block=16).collect()
    n = Counter(r.source for r in got)
    assert n["small"] > 100 and n["big"] < 900 and 950 < n["small"] + n["big"] <= 1000
    assert max(Counter(r.did for r in got).values()) <= mixing.MAX_EPOCHS + 1 and None not in n
    assert all(0 <= r.mix_pos < 1 for r in got)


def test_empty_tables(spark, rows):
    none = frame(spark, rows).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [f(none).count() for f in (fingerprint.report, simhash.components, suffixes.remove_repeats, langid.report, linededup.report, mixing.report, passages.near_passages, licenses.scan)] == [0] * 8
    assert decontam.report(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(frame(spark, rows), bench).collect())
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    twice = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, None)]
    docs = frame(spark, twice)
    for f in (fingerprint.report, simhash.components, suffixes.remove_repeats, langid.report, linededup.report, licenses.scan):
        assert f(docs).count() == 4, f
    assert simhash.near_dedup(docs).count() == 2
    assert passages.near_passages(docs).count() == 0


def test_pipeline_stages_keep_columns(spark, rows, tmp_path):
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids.isdisjoint({5, 60, 61, 62}) and not {3, 50} <= ids
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0


def test_gram_codes_are_the_grams(monkeypatch):
    texts = ["", "a", "½ 7", "İab ö b", "é" * 5, "  x\ty_z9w  ", "Der Fluss, the river; la rivière. " * 40, "😀 日本語 text"]
    for step in (langid.STEP, 7):
        monkeypatch.setattr(langid, "STEP", step)
        for text in texts:
            codes, n = langid.gram_codes(text)
            want = Counter(g for w in langid.LETTERS.findall(text.lower()) for g in langid.grams_of(w))
            assert {langid.gram_of(c): k for c, k in zip(codes.tolist(), n.tolist(), strict=True)} == want
            assert [langid.gram_of(c) for c in codes.tolist()] == sorted(want)
