"""Judged rules over documents: paragraphs first, then the sentences where these give cause; and passages in pairs.

Where a paragraph and its sentences stand, and what is around them, is found once for each, before anything is asked. The backend
is asked in mapInArrow, one request a paragraph or sentence, so its state is never more than one paragraph's, and what isn't asked
about passes by as it is. What was flagged, and the usage, is settled before notes and usage are taken from it, so that no question
is asked twice; answers and sentences without a note are not kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.functions.questions import REGISTER, Question, select_questions
from tellscan.operators.answers import KEY, answered, request_key
from tellscan.operators.arrays import let
from tellscan.operators.backend import Answer, Backend, BackendError, each, numbers
from tellscan.operators.scan import NOTE_FIELDS, context_at
from tellscan.operators.split import split
from tellscan.operators.table import block_table, line_ends, place

#: Sentences a paragraph must have for a paragraph question, bands of confidence, the listed price of a token.
MIN_SENTENCES = 3
HIGH, MEDIUM = 0.7, 0.5
USD_PER_TOKEN = 42e-9

ANSWER = "struct<rule:string,probabilities:array<double>,confidence:double>"
REQUEST = f"struct<answers:array<{ANSWER}>,usage:map<string,double>>"
ARROW_REQUEST = pa.struct([("answers", pa.list_(pa.struct([("rule", pa.string()), ("probabilities", pa.list_(pa.float64())), ("confidence", pa.float64())]))), ("usage", pa.map_(pa.string(), pa.float64()))])
#: Sentences whose answers a worker holds at once; a paragraph with more is one part.
ASKED = 2048
KEEP = "Plain, specific and short prose is wanted %{place}. Which of A and B would a careful editor print?"
DRIFT = "Does B state anything that A doesn't, or leave out anything that A states?"


def settle(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint in the folder that the cluster names for them, else, on one machine, kept on its disk."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share, or a lost executor's answers are paid for again")
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def top(probabilities: Column) -> Column:
    """The most likely level, from 0; null where two share the top."""
    best = F.array_max(probabilities)
    return F.when(F.size(F.filter(probabilities, lambda p: p == best)) == 1, F.array_position(probabilities, best).cast("int") - 1)


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def _ask(backend: Backend, state: dict, questions: dict[str, dict]) -> tuple[list[Answer], dict[str, float]]:
    """The answers in the order of questions, and the usage of the request."""
    got = backend.ask(state, questions)
    if missing := [n for n in questions if n not in got]:
        raise BackendError(f"no answer for {', '.join(missing)}")
    for n, q in questions.items():
        if not isinstance(got[n].probabilities, list) or len(got[n].probabilities) != len(q["criteria"]):
            raise BackendError(f"the answer to {n} is no score of {len(q['criteria'])} levels")
    first = next(iter(got.values()))
    return [got[n] for n in questions], {"requests": 1.0, **numbers(first.usage)}


def _requests(got: list[tuple[list[Answer], dict[str, float]] | None], questions: dict[str, dict]) -> pa.Array:
    """ARROW_REQUEST of what _ask() gave, null for none; put together by columns, since there are many."""
    asked = [a for a in got if a is not None]
    answers, usages = [x for a, _ in asked for x in a], [u for _, u in asked]

    def ends(sizes: Iterable[int]) -> pa.Array:
        return pa.array([0, *accumulate(sizes)], pa.int32())

    levels = pa.ListArray.from_arrays(ends(len(x.probabilities) for x in answers), pa.array([p for x in answers for p in x.probabilities], pa.float64()))
    of_rule = [pa.array(list(questions) * len(asked), pa.string()), levels, pa.array([x.confidence for x in answers], pa.float64())]
    each_answer = pa.StructArray.from_arrays(of_rule, fields=list(ARROW_REQUEST.field("answers").type.value_type))
    counts = pa.MapArray.from_arrays(ends(map(len, usages)), pa.array([k for u in usages for k in u], pa.string()), pa.array([v for u in usages for v in u.values()], pa.float64()))
    made = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends(len(a) for a, _ in asked), each_answer), counts], fields=list(ARROW_REQUEST))
    if len(asked) == len(got):
        return made
    places = accumulate((a is not None for a in got), initial=-1)
    next(places)
    return made.take(pa.array([k if a is not None else None for k, a in zip(places, got, strict=True)], pa.int64()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The batches in parts of about ASKED sentences, each with the number of sentences of its rows."""
    for batch in batches:
        sizes, start, held = pc.fill_null(pc.list_value_length(batch.column("sentences")), 0).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held >= ASKED or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start), sizes[start : i + 1]
                start, held = i + 1, 0


def _with(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])


def _paragraph_answers(backend: Backend, questions: dict[str, dict], register: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes in _parts(batches):
            due = list(zip(part.column("asked").to_pylist(), sizes, strict=True))
            got = each(backend, due, lambda x: _ask(backend, {"register": register, "paragraph": x[0], "sentence_count": x[1]}, questions) if x[1] >= MIN_SENTENCES else None)
            yield _with(part, "request", _requests(got, questions))

    return run


def _sentence_answers(backend: Backend, questions: dict[str, dict], register: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes in _parts(batches):
            texts, due, ends = pc.struct_field(pc.list_flatten(part.column("sentences")), "asked").to_pylist(), [], [0]
            for n in sizes:
                own = texts[ends[-1] : ends[-1] + n]
                whole = {"sentences": own}
                due += [{"register": register, "paragraph": whole, "target_index": i, "target": own[i]} for i in range(n)]
                ends.append(ends[-1] + n)
            got = each(backend, due, lambda x: _ask(backend, x, questions))
            yield _with(part, "requests", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _requests(got, questions)))

    return run


def _asker(backend: Backend, questions: dict[str, dict], register: str) -> str:
    """All that an answer hangs on besides the text."""
    return json.dumps([backend.name, getattr(backend, "model", ""), register, questions], sort_keys=True)


def _lower(confidence: Column, most: str) -> Column:
    """The band of confidence, most at the most."""
    if most == "high":
        return band(confidence)
    return F.when(confidence >= MEDIUM, "medium").otherwise("low") if most == "medium" else F.lit("low")


def _flags(answers: Column, questions: Sequence[Question], strict: bool) -> Column:
    """array of (ord, confidence): the questions whose worst level is the most likely, surely enough unless strict."""

    def judged(i: int, q: Question) -> Column:
        # answers stand in the order of the questions, but for kept ones of a run that had another order
        own = F.coalesce(F.when(F.get(answers, F.lit(i))["rule"] == q.id, F.get(answers, F.lit(i))), F.filter(answers, lambda x: x["rule"] == q.id)[0])

        def verdict(a: Column) -> Column:
            worst = F.get(a["probabilities"], F.lit(q.flag_level))
            alone = F.size(F.filter(a["probabilities"], lambda p: p >= worst)) == 1
            sure = alone if strict else alone & (a["confidence"] >= MEDIUM)
            return F.when(sure, F.struct(F.lit(i).alias("ord"), _lower(a["confidence"], q.confidence).alias("confidence")))

        return let(own, verdict)

    return F.filter(F.array(*[judged(i, q) for i, q in enumerate(questions)]), lambda x: x.isNotNull())


#: What a note says of a paragraph or sentence: its text, where it begins, and what is around it.
POINT = "struct<text:string,line:int,column:int,context:string>"
#: What is noted of each paragraph or sentence that was flagged, and what each request took.
NOTED = f"array<struct<unit:{POINT},flags:array<struct<ord:int,confidence:string>>>>"
USAGES = "array<map<string,double>>"


def _point(sentence: Column) -> Column:
    return F.struct(*[sentence[n].alias(n) for n in ("text", "line", "column", "context")])


def _placed(units: DataFrame, key: str) -> DataFrame:
    """key, asked, whole and sentences of a split with what is around: a POINT, and an array of these with asked.

    A place is taken from the block it is in, so a paragraph of many sentences isn't walked for each of them.
    """
    base, around = F.length("before"), F.concat("before", "written", "after")

    def placed(table: Column) -> Column:
        first = line_ends(F.col("before")) + 1

        def point(inside: Column, length: Column, text: Column, *more: Column) -> Column:
            def of(at: Column) -> Column:
                column = F.when(at["line"] == first, F.col("column") + inside).otherwise(at["column"])
                # what is cut off at an end is there whether this end has more text or not
                context = context_at(table, base + inside, length)
                return F.struct(text.alias("text"), (F.col("line") + at["line"] - first).alias("line"), column.alias("column"), context.alias("context"), *more)

            return let(place(table, base + inside), of)

        each = F.transform("sentences", lambda s: point(s["offset"] - F.col("offset"), s["length"], s["text"], s["asked"].alias("asked")))
        return F.struct(point(F.lit(0), F.col("length"), F.col("text")).alias("whole"), each.alias("sentences"))

    return units.select(key, "asked", let(block_table(around), placed).alias("placed")).select(key, "asked", "placed.whole", "placed.sentences")


def judge(docs: DataFrame, backend: Backend, questions: Sequence[Question] | None = None, key: str = "doc_id", text_col: str = "text", markdown: bool = False, register: str = REGISTER, strict: bool = False, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, usage). notes: key and a note's fields, and ord, as from a scan. usage: counter, total.

    Paragraph questions go to paragraphs of MIN_SENTENCES and more. Sentence questions go to shorter ones and to those
    a paragraph question flagged; to all if strict or if there is no paragraph question. Without questions no request is
    made. A failing backend fails the job. key must be unique; a row without key or text has no notes. With store, a folder,
    answers are kept there: equal requests are asked once, and a run after one that failed asks only what is left.
    """
    questions = select_questions(strict=strict) if questions is None else list(questions)
    of_paragraph, of_sentence = ([q for q in questions if q.unit == u] for u in ("paragraph", "sentence"))
    rows = docs.select(F.col(key), F.col(text_col).alias("source")).where(F.col(key).isNotNull())
    units = _placed(split(rows, key, "source", markdown, around=True), key)

    def replied(units: DataFrame, name: str, kind: str, due: Column, inputs: Sequence[str], ask: Callable, asker: str) -> DataFrame:
        """units with what was answered about the rows that are due."""
        if not store:
            return units.mapInArrow(ask, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + f", {name} {kind}")
        keyed = units.withColumn(KEY, F.when(due, request_key(asker, *key_of[name])))
        return answered(keyed, inputs, ask, name, kind, f"{store}/{folders[name]}", settle).select(*units.columns, name)

    folders = {"request": "paragraphs", "requests": "sentences"}
    key_of = {"request": (F.col("asked"), F.size("sentences")), "requests": (F.col("sentences.asked"),)}
    none = {"noted": F.array().cast(NOTED), "usages": F.array().cast(USAGES)}
    units = units.withColumns(none)
    if of_paragraph:
        asked = {q.id: q.asked(register) for q in of_paragraph}
        units = replied(units, "request", REQUEST, F.size("sentences") >= MIN_SENTENCES, ["asked", "sentences"], _paragraph_answers(backend, asked, register), _asker(backend, asked, register))
        units = units.withColumn("flags", F.when(F.col("request").isNotNull(), _flags(F.col("request.answers"), of_paragraph, strict)))
        points = {"all": F.col("whole"), "first": _point(F.element_at("sentences", 1)), "last": _point(F.element_at("sentences", -1))}

        def noted_at(part: str) -> Column:
            own = [i for i, q in enumerate(of_paragraph) if q.excerpt == part]
            return F.struct(points[part].alias("unit"), F.filter("flags", lambda f: f["ord"].isin(own)).alias("flags"))

        parts = [noted_at(part) for part in points if any(q.excerpt == part for q in of_paragraph)]
        # what no sentence is asked about goes no further than this
        left = F.col("sentences") if strict else F.when((F.size("sentences") < MIN_SENTENCES) | (F.size("flags") > 0), F.col("sentences"))
        noted = F.when(F.size("flags") > 0, F.filter(F.array(*parts), lambda n: F.size(n["flags"]) > 0)).otherwise(none["noted"])
        used = F.when(F.col("request").isNotNull(), F.array("request.usage")).otherwise(none["usages"])
        units = units.select(key, left.alias("sentences"), noted.cast(NOTED).alias("noted"), used.cast(USAGES).alias("usages"))
        units = settle(units) if store else units
    if of_sentence:
        asked = {q.id: q.asked(register) for q in of_sentence}
        units = replied(units.select(key, "sentences", "noted", "usages"), "requests", f"array<{REQUEST}>", F.col("sentences").isNotNull(), ["sentences"], _sentence_answers(backend, asked, register), _asker(backend, asked, register))

        def told(x: Column) -> Column:
            flags = F.transform(_flags(x["requests"]["answers"], of_sentence, strict), lambda f: F.struct((f["ord"] + len(of_paragraph)).alias("ord"), f["confidence"].alias("confidence")))
            return F.struct(_point(x["sentences"]).alias("unit"), flags.alias("flags"))

        each_told = F.filter(F.transform(F.arrays_zip("sentences", "requests"), told), lambda n: F.size(n["flags"]) > 0)
        noted, used = F.coalesce(each_told, none["noted"]), F.coalesce(F.col("requests.usage"), none["usages"])
        units = units.select(key, F.concat("noted", noted.cast(NOTED)).alias("noted"), F.concat("usages", used.cast(USAGES)).alias("usages"))
    units = settle(units.select(key, "noted", "usages"))
    found = units.select(key, F.inline("noted")).select(key, "unit", F.inline("flags"))
    usage = units.select(F.explode("usages").alias("usage")).select(F.explode("usage").alias("counter", "n"))

    ordered = of_paragraph + of_sentence
    fields = {name: F.coalesce(*[F.when(F.col("ord") == i, F.lit(getattr(q, a))) for i, q in enumerate(ordered)], F.lit(None).cast("string")) for name, a in (("severity", "severity"), ("rule", "id"), ("category", "category"), ("message", "message"), ("rationale", "rationale"), ("suggestion", "suggestion"))}
    fields |= {"line": F.col("unit.line"), "column": F.col("unit.column"), "confidence": F.col("confidence"), "excerpt": F.col("unit.text"), "context": F.col("unit.context"), "count": F.lit(None).cast("int")}
    totals = usage.groupBy("counter").agg(F.sum("n").alias("total"))
    return found.select(key, *[fields[n].alias(n) for n in NOTE_FIELDS], "ord"), totals


def cost(usage: DataFrame, usd_per_token: float = USD_PER_TOKEN) -> DataFrame:
    """cost_usd: what the input tokens of usage cost."""
    tokens = F.coalesce(F.sum(F.when(F.col("counter") == "input_tokens", F.col("total"))), F.lit(0.0))
    return usage.agg(F.round(tokens * usd_per_token, 6).alias("cost_usd"))


VERDICT = "keep string, p_keep_b double, keep_confidence double, drift double, drift_confidence double, usage map<string,double>"


def compare(pairs: DataFrame, backend: Backend, key: str = "pair_id", a: str = "a", b: str = "b", place: str = f"for {REGISTER}", drift: bool = False, swap: Column | None = None) -> DataFrame:
    """key, keep (A or B), p_keep_b, keep_confidence, drift, drift_confidence, usage for each pair of passages.

    Half of the pairs, by the hash of key, are asked about in the other order, since a model may favour a place; swap
    (boolean) decides otherwise. Null passages are empty ones. Each row is one request.
    """
    turned = F.pmod(F.xxhash64(F.col(key)), F.lit(2)) == 1 if swap is None else swap
    rows = pairs.select(F.col(key), F.coalesce(F.col(a), F.lit("")).alias("a"), F.coalesce(F.col(b), F.lit("")).alias("b"), turned.alias("turned"))
    questions: dict[str, dict] = {"keep": {"type": "choice", "instructions": KEEP.replace("%{place}", place), "criteria": {"A": "A is printed.", "B": "B is printed."}}}
    if drift:
        questions["drift"] = {"type": "noul", "instructions": DRIFT}

    def verdict(x: str, y: str, other_way: bool) -> tuple:
        got = backend.ask({"A": y, "B": x} if other_way else {"A": x, "B": y}, questions)
        if missing := [n for n in questions if n not in got]:
            raise BackendError(f"no answer for {', '.join(missing)}")
        keep, changed, slot = got["keep"], got.get("drift") if drift else None, "A" if other_way else "B"
        if not isinstance(keep.probabilities, dict) or slot not in keep.probabilities:
            raise BackendError("the keep answer has no probability for each of A and B")
        p = keep.probabilities[slot]
        return ("B" if p >= 0.5 else "A", p, keep.confidence, changed and changed.probabilities, changed and changed.confidence, {"requests": 1.0, **numbers(keep.usage)})

    names = [f.split()[0] for f in VERDICT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame(each(backend, zip(f["a"], f["b"], f["turned"], strict=True), lambda v: verdict(*v)), columns=names)
            out.insert(0, key, f[key].to_numpy())
            yield out

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {VERDICT}")
