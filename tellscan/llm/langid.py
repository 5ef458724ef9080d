"""Operator 9: language identification by rank-order n-gram profiles.

A profile is the list of a language's PROFILE most frequent character n-grams (1 to MAX_N letters; a word is padded by
one blank on each side). A document's own list is made alike from its whole text, and each of its n-grams counts how
far it is out of place in the profile (PROFILE where it is absent). The language with the least distance wins.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.llm._util import fresh

MAX_N = 3
PROFILE = 300
#: Documents whose remainder of crc32(doc_id as text) by FOLDS is HELD_OUT take no part in learning.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: A language with fewer n-grams than this in all its learning texts has no profile; 1 means every language has one.
MIN_GRAMS = 1
#: N-gram counts a worker holds before it passes them on, and characters of a language that it counts together.
COUNT_CACHE, TOGETHER = 500_000, 1 << 16
#: Characters of a text taken at a time, bits of a code point in a code (three fit in a long), and the blank around words.
STEP, BITS, BLANK = 1 << 20, 21, 32
#: keep() rejects a text that scores so many standard deviations less than the learning texts of its language do on average.
DEVIATIONS = 5.0
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> object:
    """crc32(doc_id as text) mod 4 is 2; a null id is in no fold and so isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def grams_of(word: str, max_n: int = MAX_N) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, max_n + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@cache
def _letter_table() -> np.ndarray:
    """Whether a code point counts as a letter, for all of them."""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in LETTERS.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        table[m.start() : m.end()] = True
    return table


def gram_codes(text: str, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the text's n-grams, codes rising. A code holds three code points and orders as the string does.

    Words share the blank between them, so an n-gram with a blank in its middle is none. A long text is taken STEP
    characters at a time.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    run = np.where(letter, points, BLANK)[kept].astype(np.int64)
    found = []
    for at in range(0, len(run), STEP):
        x = run[at : at + STEP + 2]
        n = min(STEP, len(x))
        word = x != BLANK
        code = x[:n] << 2 * BITS
        parts = [code[word[:n]]]
        if max_n > 1:
            n = min(n, len(x) - 1)
            code = code[:n] | x[1 : n + 1] << BITS
            parts.append(code)
        if max_n > 2:
            n = max(0, min(n, len(x) - 2))
            parts.append((code[:n] | x[2 : n + 2])[word[1 : n + 1]])
        found.append(np.unique(np.concatenate(parts), return_counts=True))
        if len(found) > 8:
            found = [merged(found)]
    return merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    counts = np.zeros(len(codes), dtype=np.int64)
    np.add.at(counts, at, np.concatenate([f[1] for f in found]))
    return codes, counts


def code_of(gram: str) -> int:
    return sum(ord(c) << BITS * (2 - i) for i, c in enumerate(gram))


def gram_of(code: int) -> str:
    return "".join(chr(c) for i in (2, 1, 0) if (c := code >> BITS * i & (1 << BITS) - 1))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profiles, from all rows with a language that aren't held out.

    Of n-grams that are as frequent, the first by code points ranks first. Null texts and texts without letters teach
    nothing, repeated rows as often as they stand; from an empty table nothing is learnt.
    """
    if not 1 <= max_n <= MAX_N:
        raise ValueError(f"max_n must be from 1 to {MAX_N}")
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        texts: dict[str, list[str]] = {}

        def count(lang: str) -> None:
            held.setdefault(lang, []).append(gram_codes("\n".join(texts.pop(lang)), max_n))
            if len(held[lang]) > 16:
                held[lang] = [merged(held[lang])]

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(texts):
                count(lang)
            for lang, found in held.items():
                codes, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([gram_of(c) for c in codes.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            held.clear()

        waiting: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = text.as_py()
                if has_letters(body):
                    texts.setdefault(lang, []).append(body)
                    waiting[lang] += len(body)
                    if waiting[lang] > TOGETHER:
                        count(lang)
                        waiting[lang] = 0
                        if sum(len(f[0]) for found in held.values() for f in found) > COUNT_CACHE:
                            yield from out()
                            waiting.clear()
        yield from out()

    counts = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank")


def profiles(docs: DataFrame, **options) -> dict[str, dict[str, int]]:
    """The learnt profiles on the driver: PROFILE rows a language, whatever the number of documents."""
    found: dict[str, dict[str, int]] = {}
    for r in learn(docs, **options).collect():
        found.setdefault(r.lang, {})[r.gram] = r["rank"] - 1
    return {k: found[k] for k in sorted(found) if len(found[k]) >= MIN_GRAMS}


class Judge:
    def __init__(self, profiles: dict[str, dict[str, int]], max_n: int = MAX_N, size: int = PROFILE):
        self.langs, self.max_n, self.size = list(profiles), max_n, size
        grams = {code_of(g): g for p in profiles.values() for g in p}
        self.codes = np.array(sorted(grams), dtype=np.int64)
        #: Place of each known n-gram in each profile, -1 where absent; the last column stands for all others.
        self.places = np.array([[*(p.get(grams[c], -1) for c in self.codes.tolist()), -1] for p in profiles.values()], dtype=np.int64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not has_letters(text) or not self.langs:
            return UNKNOWN, 0.0
        found, n = gram_codes(text, self.max_n)
        if len(found) > self.size:  # all that tie with the last place stay until the n-grams themselves decide
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            keep = n >= least
            found, n = found[keep], n[keep]
        top = found[np.argsort(-n, kind="stable")][: self.size]
        at = np.searchsorted(self.codes, top)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == top
        places = self.places[:, np.where(known, at, len(self.codes))]
        off = np.where(places < 0, self.size, np.abs(places - np.arange(len(top))))
        distance = off.sum(axis=1)
        best = int(distance.argmin())  # a tie goes to the first name
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(top))


def predict(docs: DataFrame, known: dict[str, dict[str, int]], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep_text: bool = True, max_n: int = MAX_N, size: int = PROFILE) -> DataFrame:
    """The columns of docs (text_col only if keep_text) with lang_pred and score.

    score is 1 minus the mean displacement over PROFILE. A null text, and one without letters, is "und" with score 0;
    so is every text when nothing was learnt (no rows with a language). Repeated rows get equal results; ties between
    languages go to the first name.
    """
    model = docs.sparkSession.sparkContext.broadcast(known)  # PROFILE n-grams a language
    names = [*docs.columns, lang_name, score_name]
    at = docs.columns.index(text_col)
    schema = docs.withColumns({lang_name: F.lit("").cast("string"), score_name: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value, max_n, size)
        for b in batches:
            out = [judge(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names)

    found = docs.mapInArrow(run, schema)
    return found if keep_text else found.drop(text_col)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (columns doc_id, text and lang); hard cases as in predict()."""
    slim = docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(slim, profiles(docs), keep_text=False)


def floors(docs: DataFrame, known: dict[str, dict[str, int]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", deviations: float = DEVIATIONS) -> dict[str, float]:
    """The least score that keep() takes for each language: what its own learning texts score, less so many standard deviations; one text has none."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    right = predict(rows, known, "text", keep_text=False).where("lang_pred = lang")
    found = right.groupBy("lang").agg((F.avg("score") - deviations * F.coalesce(F.stddev("score"), F.lit(0.0))).alias("floor"))
    return {r.lang: r.floor for r in found.collect()}  # a row for each language


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", deviations: float = DEVIATIONS, **options) -> DataFrame:
    """The rows of docs whose language is told: "und" goes, and what scores far less than texts of the language it is taken for.

    Null texts and texts without letters are "und"; so is every text when nothing was learnt. Repeated rows fare alike.
    """
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    known = profiles(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    least = floors(docs, known, id_col, text_col, lang_col, deviations)
    out = predict(docs, known, text_col, lang, score)
    floor = F.lit(0.0)
    for name, value in least.items():
        floor = F.when(F.col(lang) == name, F.lit(value)).otherwise(floor)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= floor - 1e-9)).drop(lang, score)


def naive(text: str | None, known: dict[str, dict[str, int]], size: int = PROFILE, max_n: int = MAX_N) -> tuple[str, float]:
    """What predict() gives, spelt out; for tests."""
    counts: Counter = Counter(g for w in LETTERS.findall((text or "").lower()) for g in grams_of(w, max_n))
    if not any(c.isalpha() for c in text or ""):
        return UNKNOWN, 0.0
    if not counts or not known:
        return UNKNOWN, 0.0
    top = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    far = {k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(top)) for k, p in known.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(top))
