"""Operators and the pipeline held against code that shares nothing with them, and hard inputs for all."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tellscan.llm import chat, decontam, fingerprint, graph, langid, licenses, linededup, mixing, passages, simhash, suffixes
from tellscan.llm._util import release, save, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = Path("/root/testdata")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spelt_fingerprint(text):
    """The SimHash as the contract puts it, bit by bit."""
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def spelt_components(prints):
    group = {i: i for i in prints}
    for _ in prints:
        new = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == group:
            break
        group = new
    return group


def test_fingerprint_bits_are_those_of_the_contract(spark):
    rng = random.Random(41)
    texts = ["", None, "One", "a b c d", "A b\tC\u00a0d e", "ÄÖ ä\u2003ö x", " ".join(["same words here now"] * 9), *(words(rng, n) for n in (3, 4, 5, 6, 90, 700))]
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: spelt_fingerprint(t) for i, t in enumerate(texts)}
    halves = [h for h in (xxhash.xxh64_intdigest(f"t{k}".encode(), seed=42) for k in range(2))]
    assert spelt_fingerprint("t0 t1") == spelt_fingerprint("T0 T1") and halves[0] & halves[1] >= 0


@pytest.mark.parametrize("options", [{}, {"tile": 3}, {"tile": 5, "blocks": 6}, {"blocks": 7}])
def test_all_links_are_found_whatever_the_tiles(spark, options):
    rng = random.Random(43)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in list(prints):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
            prints.append(p)
    prints += [0, (1 << 64) - 1, 15, 7 << 60]
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r.node % (1 << 64): r.root for r in graph.connected_components(simhash.links(fps, **options)).collect()}
    want = spelt_components({p: p for p in prints})
    classes = {}
    for p, c in want.items():
        classes.setdefault(c, set()).add(p)
    found = {}
    for p in set(prints):
        found.setdefault(got.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


@pytest.mark.parametrize("together", [500_000, 20])
def test_components_of_long_chains_and_random_edges(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(73)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(5000, 5150)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame([*edges, *edges[:5]], "src long, dst long").repartition(3)
    assert {r.node: r.root for r in graph.connected_components(rows).collect()} == root
    pairs = rows.select(*[F.struct(F.col(c).alias("t"), F.lit(1).alias("u")).alias(c) for c in ("src", "dst")])
    assert {r.node.t: r.root.t for r in graph.connected_components(pairs).collect()} == root
    assert graph.connected_components(rows.where("false")).count() == 0


def spelt_profiles(rows, size=300):
    """rank of each n-gram by language, from grams spelt out word by word."""
    counts = {}
    for doc_id, text, lang in rows:
        if lang is None or zlib.crc32(str(doc_id).encode()) % 4 == 2:
            continue
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for gram in (f" {w} "[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n)):
                if gram != " ":
                    counts.setdefault(lang, Counter())[gram] += 1
    return {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for lang, c in counts.items()}


def test_profiles_are_learnt_from_the_right_rows(spark):
    rng = random.Random(47)
    rows = [(i, words(rng, 30) if i % 3 else "la maison est là où la rivière naît", ["x", "y", None][i % 3]) for i in range(60)] + [(100, None, "x"), (101, "77 !!", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.profiles(docs) == spelt_profiles(rows)


def test_texts_of_no_learnt_language_go_and_others_stay(spark):
    rng = random.Random(53)
    here = [f"{a}{b}" for a in ("ba", "le", "no", "ri") for b in ("ta", "me", "so")]
    rows = [(i, " ".join(rng.choice(here) for _ in range(rng.randrange(4, 60))), "en", "s", 0) for i in range(80)]
    rows += [(900, "Широкая река течёт мимо старого города и дальше к морю.", None, "s", 0), (901, "123 456", "en", "s", 0), (902, None, "en", "s", 0)]
    kept = {r.doc_id for r in langid.keep(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(80))
    assert langid.keep(spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit(None).cast("string"))).count() == 0


def spelt_canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def test_document_fingerprints_tell_canonical_texts_apart(spark):
    texts = ["Straße  1", "STRASSE 1", "ﬁn", "fin", "a\u00a0b", "a b", "İ", "i̇", "½", "1⁄2", "é", "e\u0301", "", None, " \n", "x" * 9, "X" * 9, "x" * 10]
    rows = {r.doc_id: r for r in fingerprint.report(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (rows[i].fingerprint == rows[j].fingerprint) == (spelt_canonical(texts[i]) == spelt_canonical(texts[j])), (texts[i], texts[j])
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert rows[i].near_edited == float(spelt_canonical(new) == spelt_canonical(t)) and rows[i].near_next == float(spelt_canonical(after) == spelt_canonical(t))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_repeats_of_400_bytes_on_a_whole_table(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    starts = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 399):
            if starts[t[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore"))
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs, with_text=True).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_an_item_beyond_one_part_and_many_equal_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART", 7)
    rng = random.Random(59)
    long_item = words(rng, 90)
    bench = [(1, long_item), (2, long_item), *((3, "a b c") for _ in range(50)), (4, words(rng, 40))]
    texts = [(1, long_item, "s"), (2, " ".join(long_item.split()[20:40]) + " " + words(rng, 30, 9), "s"), (3, "x a B c y", "s"), (4, " ".join(long_item.split()[20:32]), "s")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    for size in (1 << 20, 500):
        got = {r[0]: tuple(r)[1:] for r in decontam.report(frame(spark, texts), items, pass_bytes=size).collect()}
        assert got == {i: decontam.naive(t, [(str(k), b) for k, b in bench]) for i, t, _ in texts}
    assert got[1][2] == 2 and got[3][4] and not got[4][4]
    dealt, passes = decontam._dealt(items, "item_id", "text", decontam.WINDOW, 500)
    assert passes > 1 and dealt.groupBy("pass").agg(F.sum(F.octet_length("body")).alias("b"), F.count("*").alias("n")).where("b > 500 and n > 1").isEmpty()


LICENCES = Path("/usr/share/common-licenses")
FULL = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-or-later", "GFDL-1.3": "GFDL-1.3-or-later", "GPL-1": "GPL-1.0-or-later", "GPL-2": "GPL-2.0-or-later", "GPL-3": "GPL-3.0-or-later", "LGPL-2": "LGPL-2.0-or-later", "LGPL-2.1": "LGPL-2.1-or-later", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not LICENCES.exists(), reason="no licence texts on this machine")
def test_full_licence_texts(spark):
    here = [n for n in FULL if (LICENCES / n).exists()]
    docs = frame(spark, [(i, (LICENCES / n).read_text(errors="replace"), "s") for i, n in enumerate(here)])
    got = {here[r.doc_id]: r.license for r in licenses.scan(docs).collect()}
    assert got == {n: FULL[n] for n in here}


def test_known_sentences_between_those_of_a_rule(spark):
    s = licenses.SENTENCES
    texts = ["\n\n".join([s["mit-grant"], s["apache-copy"], s["mit-condition"], "Something else.", s["mit-warranty"]]), "\n".join([s["mit-grant"], *[s["apache-copy"]] * 3, s["mit-condition"], s["mit-warranty"]]), s["isc-grant"], s["0bsd-grant"], s["unlicense"], s["agpl3-free"], "\n".join([s["bsd-redistribution"], s["bsd-source"], s["bsd-binary"], s["bsd-regents"]])]
    got = [r.license for r in licenses.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == ["MIT", None, "ISC", "0BSD", "Unlicense", "AGPL-3.0-or-later", "BSD-3-Clause"]


CLASHING = ("did", "th", "t", "u", "h", "k", "body", "item", "pass", "salt", "root", "fp", "cdc_id", "run_gone", "n_lines", "n_removed", "sim_root", "sim_id", "sim_th", "mix_id", "mix_id_source", "mix_epoch", "mix_source", "lang_pred", "lang_score", "hit_spans", "hit_items", "n_words", "n_hit", "tile", "ones", "band", "rng", "tail", "_1", "epoch", "block")


def test_columns_with_the_operators_own_names(spark):
    rng = random.Random(61)
    rows = [(i, words(rng, 60) if i % 4 else words(random.Random(1), 80), f"s{i % 2}") for i in range(12)] + [(99, None, None)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in CLASHING})
    bench = spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    plain = frame(spark, rows)
    for f in (fingerprint.report, simhash.components, suffixes.remove_repeats, langid.report, linededup.report, mixing.report, passages.near_passages, licenses.scan):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect())), f
    assert sorted(map(str, decontam.report(docs, bench).collect())) == sorted(map(str, decontam.report(plain, bench).collect()))
    for stage in (langid.keep, linededup.line_dedup, simhash.near_dedup, lambda d: decontam.decontaminate(d, bench)):
        kept = stage(docs)
        assert {"doc_id", "text", "source"} <= set(kept.columns) and len(set(kept.columns)) == len(kept.columns)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in stage(plain).collect())
    assert mixing.mix(docs).count() == mixing.mix(plain).count()
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    clash = turns.withColumns({c: F.lit("x") for c in ("h", "prefix", "n_turns", "part", "rendered", "copies", "full", "last", "pos")})
    assert sorted(map(str, chat.collapse(clash).collect())) == sorted(map(str, chat.collapse(turns).collect()))


def test_texts_of_a_megabyte(spark):
    rng = random.Random(67)
    long_text = "\n".join(words(rng, 12, 10**5) for _ in range(12_000))
    texts = [(1, long_text, "s"), (2, long_text, "s"), (3, "x" + long_text[: 1 << 20], "s"), (4, "a" * (1 << 20), "s"), (5, " ".join(["w"] * 300_000), "t"), (6, "é" * 400_000, "t")]
    assert len(long_text) > 1 << 20
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(1, " ".join(long_text.split()[5000:5040]))], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in decontam.report(docs, bench).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    prints = {r.doc_id: r.fingerprint for r in fingerprint.report(docs).collect()}
    assert prints[1] == prints[2] != prints[3]
    groups = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert groups[1] == groups[2] == 1
    left = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert left[1].n_removed == left[1].n_bytes and left[4].n_removed == 1 << 20 and left[3].n_removed >= (1 << 20) - 400
    assert {r.class_id for r in passages.near_passages(docs).where("doc_id <= 3").collect()} == {1}
    runs = {r.doc_id: r.n_removed for r in linededup.dedup_runs(docs).collect()}
    assert runs[1] == 0 and runs[2] == 12_000
    assert langid.report(docs).count() == licenses.scan(docs).count() == linededup.report(docs).count() == 6
    assert mixing.draws(docs).count() >= 4


def test_ties_are_settled_by_name_and_place(spark):
    docs = spark.createDataFrame([(0, "abc", "y"), (1, "abc", "x"), (4, "abc", None)], "doc_id long, text string, lang string")
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i in (0, 1)} == {False}
    assert {r.lang_pred for r in langid.report(docs).collect()} == {"x"}
    lines = "one line\nand another\nand a third one\nand the fourth"
    same = linededup.dedup_runs(frame(spark, [(7, lines, "s"), (3, lines, "s"), (5, "x\n" + lines, "s")])).collect()
    assert {r.doc_id: r.n_removed for r in same} == {3: 0, 5: 4, 7: 4}
    assert {r.component_id for r in simhash.components(frame(spark, [(9, "a b", "s"), (8, "a b", "s"), (8, "A  B", "t")])).collect()} == {8}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Elsewhere
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session)
    kept = save(spark.range(3), "test")
    assert kept.count() == 3 and kept.saved_at.startswith(shared_dir(spark))
    release(kept)
    assert not Path(kept.saved_at.removeprefix("file://")).exists()


def spelt_lines(rows):
    """Texts less all lines of repeated runs of two and more lines, in order of (doc_id, text hash)."""
    seen, out = set(), {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for s in range(max(len(lines) - 1, 1)):
            piece = tuple(lines[s : s + 2])
            gone |= set(range(s, min(s + 2, len(lines)))) if piece in seen else set()
            seen.add(piece)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_pipeline_matches_stages_spelt_out(spark, tmp_path):
    rng = random.Random(71)
    here = [f"{a}{b}{c}" for a in ("ba", "le", "no", "ri") for b in ("ta", "me", "so", "lu") for c in "aeiou"]
    line = lambda n: " ".join(rng.choice(here) for _ in range(n))
    block = [line(8) for _ in range(6)]
    rows = [(i, "\n".join(line(rng.randrange(5, 15)) for _ in range(rng.randrange(3, 9))), f"s{i % 3}") for i in range(60)]
    rows += [(60 + k, "\n".join([line(9), *block, line(9)]), "s1") for k in range(3)] + [(70, rows[4][1], "s0"), (71, rows[5][1] + " tail", "s2")]
    item = line(30)
    rows += [(80, f"{line(20)} {item}", "s0"), (81, "12 34", "s0"), (82, None, "s1"), (83, "Широкая река течёт мимо старого города", "s1"), (84, "", "s2")]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    profiles = spelt_profiles([(i, t, "en") for i, t, _ in rows])
    score = {i: langid.naive(t, profiles) for i, t, _ in rows}
    learnt = [score[i][1] for i, t, _ in rows if score[i][0] == "en" and zlib.crc32(str(i).encode()) % 4 != 2]
    mean = sum(learnt) / len(learnt)
    floor = mean - 5 * (sum((x - mean) ** 2 for x in learnt) / (len(learnt) - 1)) ** 0.5
    kept = [(i, t, s) for i, t, s in rows if score[i][0] == "en" and score[i][1] >= floor]
    assert {i for i, _, _ in rows} - {i for i, _, _ in kept} >= {81, 82, 83, 84}
    cut = spelt_lines([(i, t) for i, t, _ in sorted(kept)])
    groups = spelt_components({i: spelt_fingerprint(t) for i, t in cut.items()})
    kept = [(i, cut[i], s) for i, _, s in kept if groups[i] == i]
    kept = [(i, t, s) for i, t, s in kept if not decontam.naive(t, [("1", item)])[-1]]
    assert 80 not in {i for i, _, _ in kept} and len({60, 61, 62} & {i for i, _, _ in kept}) == 3

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    drawn = con.execute(f"SELECT doc_id, epoch, mix_pos FROM ({mixing.ORACLE_SQL})").fetchall()
    text = {i: t for i, t, _ in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.mix_epoch, round(r.mix_pos, 6)) for r in got) == sorted((i, e, round(p, 6)) for i, e, p in drawn)
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in got)
