"""Queries of judged rules, labels, comparison and calibration over the driver's tables, with the deterministic backend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellscan.functions.questions import QUESTIONS, question_catalog, select_questions
from tellscan.operators.backend import WordBackend
from tellscan.operators.calibrate import FLOORS, GATE_AGREE, GATE_AUC, GATE_FLIP, GATE_PAIRS, GATED, agreement, flips
from tellscan.operators.corpus import HUMAN, both_orders, calibration, flagged_units, pairs_of, rank_auc, scored
from tellscan.operators.furniture import BULLET, CODE_INDENT, CONTINUED, FRONT, FURNITURE, HTML_LINE, INLINE, LONE_INLINE, LONE_INLINE_ENDED, ORDERED, ORDERED_FIRST, SETEXT_UNDERLINE
from tellscan.operators.judge import HIGH, MEDIUM, MIN_SENTENCES, compare, judge, settle
from tellscan.operators.labels import score_rules, totals
from tellscan.operators.scan import MARKDOWN_NOISE
from tellscan.operators.split import split
from tellscan.plans.queries import DEFAULT, ORACLE_SQL as SQL, SENTENCES, SQL_DOCUMENTS, documents, spread
from tellscan.plans.rule_sql import sql_count

#: What is put before and after every third text: what Markdown takes for no prose.
BEFORE, AFTER = "---\ntitle: none\n---\n\n# Heading\n\n- item\n  goes on\n\n", "\n\n```\ncode. Code.\n```\n\nSee `x`. Then https://example.org goes.\n"


def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, offset, length, text, asked, n_sentences of texts read as Markdown."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = split(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(BEFORE), "text", F.lit(AFTER))).otherwise(F.col("text"))), markdown=True)
    return found.select("doc_id", "paragraph", "offset", "length", "text", "asked", F.size("sentences").alias("n_sentences"))


def judge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, their levels in one text, and how many turns of the conversations each would flag."""
    flagged = turn_scores(spark, sf_dir).groupBy("rule").agg(F.count_if(F.col("flagged") & (F.col("confidence") >= MEDIUM)).alias("n_flagged"))
    asked = question_catalog(spark).withColumn("levels", F.array_join("levels", " | "))
    return asked.join(flagged.withColumnRenamed("rule", "id"), "id", "left")


def judged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), WordBackend())[0]


def judged_places(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    """doc_id, line, column, rule, severity, confidence, excerpt of the judged notes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return judge(documents(spark, sf_dir), WordBackend(), strict=strict)[0].select("doc_id", "line", "column", "rule", "severity", "confidence", "excerpt")

    return run


def judge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), WordBackend())[1]


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counter, total: how many requests the judged notes of the documents take."""
    return judge_usage(spark, sf_dir).where("counter = 'requests'")


def compare_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two turns that follow each other is kept."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pairs = turns.select(F.concat_ws("/", "conv_id", "turn", "role").alias("pair_id"), F.col("text").alias("a"), after.alias("b")).where("b is not null")
    return compare(pairs, WordBackend()).select("pair_id", "keep", F.round("p_keep_b", 6).alias("p_keep_b"), F.round("keep_confidence", 6).alias("keep_confidence"))


#: Two runs that see a little more or less in a text, and a judge that favours the first place.
ONE, AGAIN, PARTIAL = WordBackend(), WordBackend(bias=0.03), WordBackend(favour=0.02)


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a unit about its conversation: what a user says is the human side."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    side = F.when(F.col("role") == "user", HUMAN).otherwise(F.col("role"))
    return spread(turns).select(F.col("conv_id").alias("source_id"), "turn", F.lit("chat").alias("register"), side.alias("side"), F.col("text").alias("asked"))


def turn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, turn, register, side, rule, score, flagged, confidence, flagged_again: every question about every turn, twice."""
    turns = _spoken(spark, sf_dir)
    both = [scored(turns, ONE, AGAIN, QUESTIONS, unit) for unit in ("paragraph", "sentence")]
    return both[0].unionByName(both[1]).withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6)})


def role_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_auc(turn_scores(spark, sf_dir))


def flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_units(turn_scores(spark, sf_dir))


def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement(turn_scores(spark, sf_dir), "register", "confidence", "flagged", "flagged_again")


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each side of a conversation against the user's first, in both orders."""
    turns = _spoken(spark, sf_dir).where(F.col("asked").isNotNull())
    firsts = turns.groupBy("source_id", "register", "side").agg(F.min(F.struct("turn", "asked")).alias("t")).select("source_id", "register", "side", F.col("t.asked").alias("asked"))
    return both_orders(pairs_of(firsts), PARTIAL)


def flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flips(_turned(spark, sf_dir), "register", "confidence", "keep", "keep_again")


def gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(settle(turn_scores(spark, sf_dir)), _turned(spark, sf_dir), "assistant", "chat")


def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a labelled paragraph: its sentence is the example or counterexample that was added to it."""
    sentence = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod("doc_id", F.lit(len(SENTENCES))) + 1).cast("int"))
    rows = documents(spark, sf_dir).select(sentence.alias("sentence"), F.col("text").alias("paragraph"), (F.col("doc_id") % 2 == 0).alias("slop"), F.col("source").alias("family"), F.lit(None).cast("string").alias("shape"))
    return totals(score_rules(rows, DEFAULT))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "markdown_paragraphs": markdown_paragraphs,
    "judge_catalog": judge_catalog,
    "judged_notes": judged_notes,
    "judged_places": judged_places(False),
    "judged_places_strict": judged_places(True),
    "judge_usage": judge_usage,
    "judge_requests": judge_requests,
    "compare_turns": compare_turns,
    "turn_scores": turn_scores,
    "role_auc": role_auc,
    "flag_table": flag_table,
    "run_agreement": run_agreement,
    "flip_rates": flip_rates,
    "gate_lines": gate_lines,
    "label_totals": label_totals,
}



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PLAIN = "coalesce(len(list_filter(regexp_extract_all({0}, '[^\\s\\v]+'), lambda w: regexp_matches(w, '[0-9A-Z]'))) / nullif(len(regexp_extract_all({0}, '[^\\s\\v]+')), 0), 0)"
_FLOORS = "f AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in FLOORS) + "]) AS floor)"


def _flag(p: str) -> str:
    return f"{p}[1] = list_max({p}) AND len(list_filter({p}, lambda v: v = list_max({p}))) = 1"


def _levels(x: str) -> str:
    return f"list_transform(range(levels), lambda i: abs(1 - abs(least(1::DOUBLE, 4 * {x}) - i / (levels - 1))))"


if any(q.flag_level for q in QUESTIONS):
    raise ValueError("the SQL takes the first level for the flagged one")
_SQUASHED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"
_GRADES = "['high', 'medium', 'low']"


def _sql_judged(strict: bool) -> str:
    """The judged notes of documents by the backend that counts words, from the paragraphs and sentences that SQL finds."""
    asked = select_questions(strict=strict)
    rows = ", ".join(f"({i}, {_text(q.id)}, {_text(q.unit)}, {len(q.levels)}, {_text(q.severity)}, {_text(q.confidence)}, {_text(q.excerpt)})" for i, q in enumerate(asked))
    sure = "confidence >= 0" if strict else f"confidence >= {MEDIUM}"
    judged = f"SELECT *, CASE WHEN confidence >= {HIGH} THEN 'high' WHEN confidence >= {MEDIUM} THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, least(1::DOUBLE, 2 * (list_reverse_sort(p)[1] - list_reverse_sort(p)[2])) AS confidence FROM (SELECT *, list_transform(raw, lambda v: v / list_sum(raw)) AS p FROM (SELECT *, {_levels('x')} AS raw FROM {{0}}))) WHERE {_flag('p')} AND {sure}"
    due = "TRUE" if strict else f"k < {MIN_SENTENCES} OR (doc_id, paragraph) IN (SELECT (doc_id, paragraph) FROM flagged)"
    return f"""{SQL["sentence_spans"][: SQL["sentence_spans"].rindex('SELECT doc_id')].rstrip()},
      sents AS ({SQL["sentence_spans"][SQL["sentence_spans"].rindex('SELECT doc_id') :]}),
      questions AS (SELECT * FROM (VALUES {rows}) q(ord, rule, unit, levels, severity, grade, excerpt_of)),
      paras AS (SELECT p.doc_id, p.paragraph, p."offset", {_SQUASHED.format('p.text')} AS text, count(*) AS k, arg_min(s."offset", s.sentence) AS first_at, arg_max(s."offset", s.sentence) AS last_at, arg_min(s.text, s.sentence) AS first_text, arg_max(s.text, s.sentence) AS last_text FROM p JOIN sents s USING (doc_id, paragraph) GROUP BY ALL),
      of_paras AS (SELECT * FROM (SELECT *, {_PLAIN.format('text')} AS x FROM paras WHERE k >= {MIN_SENTENCES}), questions WHERE unit = 'paragraph'),
      flagged AS ({judged.format('of_paras')}),
      of_sents AS (SELECT * FROM (SELECT s.doc_id, s.paragraph, s."offset", s.text, {_PLAIN.format('s.text')} AS x FROM sents s JOIN paras USING (doc_id, paragraph) WHERE {due}), questions WHERE unit = 'sentence'),
      notes AS (SELECT doc_id, rule, severity, grade, band, CASE excerpt_of WHEN 'first' THEN first_at WHEN 'last' THEN last_at ELSE "offset" END AS at_, CASE excerpt_of WHEN 'first' THEN first_text WHEN 'last' THEN last_text ELSE text END AS excerpt FROM flagged
        UNION ALL SELECT doc_id, rule, severity, grade, band, "offset", text FROM ({judged.format('of_sents')}))
      SELECT doc_id, (length(pre) - length(replace(pre, chr(10), '')) + 1)::INT AS line, (length(string_split(pre, chr(10))[-1]) + 1)::INT AS "column", rule, severity, {_GRADES}[greatest(list_position({_GRADES}, band), list_position({_GRADES}, grade))] AS confidence, excerpt
      FROM (SELECT n.*, left(d.text, at_) AS pre FROM notes n JOIN d USING (doc_id))"""


_SCORES = f"""t AS (SELECT conv_id AS source_id, turn, 'chat' AS register, CASE role WHEN 'user' THEN '{HUMAN}' ELSE role END AS side, {_PLAIN.format("text")} AS x FROM conversations WHERE text IS NOT NULL),
q AS (SELECT * FROM (VALUES {", ".join(f"('{q.id}', {len(q.levels)})" for q in QUESTIONS)}) q(rule, levels)),
r AS (SELECT t.*, rule, levels, {_levels("x")} AS r1, {_levels(f"(x + {AGAIN.bias}::DOUBLE)")} AS r2 FROM t, q),
p AS (SELECT *, list_transform(r1, lambda v: v / list_sum(r1)) AS p1, list_transform(r2, lambda v: v / list_sum(r2)) AS p2 FROM r),
s AS (SELECT source_id, turn, register, side, rule, round(list_sum(list_transform(range(levels), lambda i: p1[i + 1] * i)), 6)::DOUBLE AS score, {_flag("p1")} AS flagged,
  round(least(1::DOUBLE, 2 * (list_reverse_sort(p1)[1] - list_reverse_sort(p1)[2])), 6)::DOUBLE AS confidence, {_flag("p2")} AS flagged_again FROM p)"""
_AUC = f"""u AS (SELECT register, rule, m.side, s.score, s.side <> '{HUMAN}' AS model FROM s JOIN (SELECT DISTINCT register, rule, side FROM s WHERE side <> '{HUMAN}') m USING (register, rule) WHERE s.side = m.side OR s.side = '{HUMAN}'),
k AS (SELECT *, rank() OVER (PARTITION BY register, side, rule ORDER BY score) + (count(*) OVER (PARTITION BY register, side, rule, score) - 1) / 2.0 AS k FROM u),
a AS (SELECT register, side, rule, count(*) FILTER (model) AS n_pos, count(*) FILTER (NOT model) AS n_neg, sum(k) FILTER (model) AS ranks FROM k GROUP BY register, side, rule),
auc AS (SELECT register, side, rule, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9)::DOUBLE END AS auc FROM a)"""
_BANDS = f"{_FLOORS}, g AS (SELECT register, floor, count(*) FILTER (confidence >= floor) AS n, count(*) FILTER (confidence >= floor AND flagged = flagged_again) AS agreed FROM s CROSS JOIN f GROUP BY register, floor)"
_TURNED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS place FROM conversations WHERE text IS NOT NULL),
w AS (SELECT role, {_PLAIN.format("h.text")} AS xa, {_PLAIN.format("m.text")} AS xb FROM (SELECT * FROM o WHERE place = 1 AND role <> 'user') m JOIN (SELECT conv_id, text FROM o WHERE place = 1 AND role = 'user') h USING (conv_id)),
v AS (SELECT least(1::DOUBLE, greatest(0::DOUBLE, 0.5::DOUBLE + (xa - xb) / 2 + {PARTIAL.favour}::DOUBLE)) AS pa, least(1::DOUBLE, greatest(0::DOUBLE, 0.5::DOUBLE + (xb - xa) / 2 + {PARTIAL.favour}::DOUBLE)) AS pb FROM w),
c AS (SELECT 1 - pa >= 0.5 AS keep, pb >= 0.5 AS keep_again, least(abs(2 * pa - 1), abs(2 * pb - 1)) AS sure FROM v),
fl AS (SELECT 'chat' AS register, floor, count(*) FILTER (sure >= floor) AS n, count(*) FILTER (sure >= floor AND keep <> keep_again) AS flipped FROM c CROSS JOIN f GROUP BY floor)"""
_JUDGED = _sql_judged(False)
_ADDED = ", ".join("'" + t.replace("'", "''") + "'" for t in SENTENCES)
_HITS = " UNION ALL ".join(f"SELECT '{r.id}' AS rule, family, slop, {sql_count(r, 'chr(10) || chr(10) || sentence')} > 0 AS hit FROM l" for r in DEFAULT)
ORACLE_SQL: dict[str, str] = {
    "judge_catalog": f"WITH {_SCORES}, n AS (SELECT rule AS id, count(*) FILTER (flagged AND confidence >= {MEDIUM}) AS n_flagged FROM s GROUP BY rule) SELECT * FROM (VALUES " + ", ".join(f"({i}::INT, {_text(q.id)}, {_text(q.unit)}, {_text(q.severity)}, {_text(q.confidence)}, {_text(q.excerpt)}, {_text(q.instructions)}, {_text(' | '.join(q.levels))}, {_text(q.message)}, {_text(q.suggestion)})" for i, q in enumerate(QUESTIONS)) + ") t(ord, id, unit, severity, confidence, excerpt, instructions, levels, message, suggestion) LEFT JOIN n USING (id)",
    "judge_requests": f"{_JUDGED[: _JUDGED.index('of_sents AS')].rstrip().rstrip(',')} SELECT 'requests' AS counter, ((SELECT count(*) FROM paras WHERE k >= {MIN_SENTENCES}) + (SELECT count(*) FROM sents s JOIN paras USING (doc_id, paragraph) WHERE k < {MIN_SENTENCES} OR (doc_id, paragraph) IN (SELECT (doc_id, paragraph) FROM flagged)))::DOUBLE AS total",
    "compare_turns": f"WITH p AS (SELECT concat_ws('/', conv_id, turn, role) AS pair_id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations), q AS (SELECT pair_id, {_PLAIN.format('b')} - {_PLAIN.format('a')} AS d FROM p WHERE b IS NOT NULL) SELECT pair_id, CASE WHEN d >= 0 THEN 'B' ELSE 'A' END AS keep, round(0.5 + d / 2, 6)::DOUBLE AS p_keep_b, round(abs(d), 6)::DOUBLE AS keep_confidence FROM q",
    "judged_places": _sql_judged(False),
    "judged_places_strict": _sql_judged(True),
    "turn_scores": f"WITH {_SCORES} SELECT * FROM s",
    "role_auc": f"WITH {_SCORES}, {_AUC} SELECT * FROM auc",
    "flag_table": f"WITH {_SCORES} SELECT register, side, rule, count(*) FILTER (flagged AND confidence >= {MEDIUM}) AS n_flagged, count(*) AS n FROM s GROUP BY register, side, rule",
    "run_agreement": f"WITH {_SCORES}, {_BANDS} SELECT register, floor, n, agreed, CASE WHEN n > 0 THEN round(agreed / n, 9)::DOUBLE END AS rate FROM g",
    "flip_rates": f"WITH {_FLOORS}, {_TURNED} SELECT register, floor, n, flipped, CASE WHEN n > 0 THEN round(flipped / n, 9)::DOUBLE END AS rate FROM fl",
    "gate_lines": f"WITH {_SCORES}, {_AUC}, {_BANDS}, {_TURNED} SELECT 'auc' AS gate, rule AS subject, CASE WHEN auc < {GATE_AUC} THEN 'ok' ELSE 'FAIL' END AS status, auc AS value, NULL::BIGINT AS n FROM auc WHERE side = 'assistant' AND rule IN {GATED} UNION ALL SELECT 'flip', 'compare', CASE WHEN n < {GATE_PAIRS} THEN 'n/a' WHEN flipped / n < {GATE_FLIP} THEN 'ok' ELSE 'FAIL' END, CASE WHEN n > 0 THEN round(flipped / n, 9) END, n FROM fl WHERE floor = {FLOORS[0]} UNION ALL SELECT 'agreement', 'check', CASE WHEN agreed / nullif(n, 0) >= {GATE_AGREE} THEN 'ok' ELSE 'FAIL' END, round(agreed / nullif(n, 0), 9), n FROM g WHERE floor = {FLOORS[0]}",
    "label_totals": f"WITH {SQL_DOCUMENTS}, l AS (SELECT source AS family, doc_id % 2 = 0 AS slop, ([{_ADDED}])[(doc_id % {len(SENTENCES)} + 1)::INT] AS sentence FROM d WHERE text IS NOT NULL), h AS ({_HITS}) SELECT rule, family, count(*) FILTER (slop AND hit) AS slop_hit, count(*) FILTER (slop) AS slop_all, count(*) FILTER (NOT slop AND NOT hit) AS plain_pass, count(*) FILTER (NOT slop) AS plain_all FROM h GROUP BY rule, family",
}


def _sql_markdown() -> str:
    """markdown_paragraphs as SQL: noise as blanks, lines read one after the other with flags, paragraphs and sentences of what is left."""
    noise = MARKDOWN_NOISE.replace("(?md)", "(?m)")
    shapes = {"furniture": FURNITURE, "ordered": ORDERED, "first": ORDERED_FIRST, "bullet": BULLET, "continued": CONTINUED, "indented": CODE_INDENT, "html": HTML_LINE, "lone": LONE_INLINE, "ended": LONE_INLINE_ENDED}

    def like(pattern: str, x: str = "x") -> str:
        return f"regexp_matches({x}, {_text(pattern)})"

    def blanked(inline: str) -> str:
        one = f"CASE WHEN contains(m, chr(10)) OR starts_with(m, '<!--') THEN regexp_replace(m, '[^\\n]', ' ', 'g') ELSE {inline} END"
        return f"array_to_string(list_transform(string_split(regexp_replace(text, {_text(noise)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)), lambda x: CASE WHEN contains(x, chr(2)) THEN (list_transform([split_part(x, chr(2), 1)], lambda m: {one}))[1] || split_part(x, chr(2), 2) ELSE x END), '')"

    shape = ", ".join(f"'{n}': {like(q)}" for n, q in shapes.items())
    flags = ", ".join(f"'{n}': FALSE" for n in (*shapes, "blank", "title"))
    listed = "(x.bullet OR (x.ordered AND (NOT a.prose OR x.first)))"
    item = f"({listed} OR (a.item AND x.continued))"
    code = "((a.code AND (x.indented OR x.blank)) OR (x.indented AND NOT a.item AND a.opens))"
    gone = f"(a.k < x.front OR {code} OR {item} OR x.furniture OR x.title OR a.titled OR x.html OR x.lone OR (NOT a.prose AND x.ended))"
    keep = ", ".join(f"'{n}': FALSE" for n in (*shapes, "blank", "title"))
    step = f"{{{keep}, 'front': 0::BIGINT, 'k': a.k + 1, 'item': {item}, 'prose': NOT {gone} AND NOT x.blank, 'code': {code}, 'opens': x.blank OR {gone}, 'titled': x.title, 'out': a.out || CASE WHEN {gone} THEN '1' ELSE '0' END}}"
    start = f"{{{flags}, 'front': 0::BIGINT, 'k': 0::BIGINT, 'item': FALSE, 'prose': FALSE, 'code': FALSE, 'opens': TRUE, 'titled': FALSE, 'out': ''}}"
    wiped = "array_to_string(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN gone[i] = '1' THEN regexp_replace({0}[i], '[^\\r]', ' ', 'g') ELSE {0}[i] END), chr(10))"
    own = f"""s0 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_sql_text(BEFORE)} || text || {_sql_text(AFTER)} ELSE text END AS text FROM documents WHERE text IS NOT NULL),
      s1 AS (SELECT *, string_split({blanked(f"repeat('{INLINE}', length(m))")}, chr(10)) AS body, string_split({blanked('m')}, chr(10)) AS shown FROM s0),
      s2 AS (SELECT *, list_transform(body, lambda x: regexp_replace(x, '\\r$', '')) AS bare FROM s1),
      s3 AS (SELECT *, list_transform(bare, lambda x: {like(FRONT)}) AS fence FROM s2),
      s4 AS (SELECT *, CASE WHEN fence[1] AND list_position(fence[2:], TRUE) > 0 THEN list_position(fence[2:], TRUE) + 1 ELSE 0 END AS front FROM s3),
      s5 AS (SELECT *, list_transform(range(1, len(bare) + 1), lambda i: (list_transform([bare[i]], lambda x: {{{shape}, 'blank': NOT regexp_matches(x, '[^\\s\\v\\x00]'), 'title': regexp_matches(x, '[^\\s\\v\\x00]') AND coalesce({like(SETEXT_UNDERLINE, 'bare[i + 1]')}, FALSE),
        'front': front::BIGINT, 'k': 0::BIGINT, 'item': FALSE, 'prose': FALSE, 'code': FALSE, 'opens': TRUE, 'titled': FALSE, 'out': ''}}))[1]) AS lines FROM s4),
      s6 AS (SELECT *, list_reduce(list_prepend({start}, lines), lambda a, x: {step}).out AS gone FROM s5),
      s7 AS (SELECT doc_id, text AS whole, {wiped.format('body')} AS text, {wiped.format('shown')} AS asked FROM s6),
      d AS (SELECT doc_id, text FROM s7)"""
    spoken = SQL["sentence_spans"].replace(SQL_DOCUMENTS, own).replace("A-Z0-9])', '", f"A-Z0-9{INLINE}])', '")
    cut = spoken.rindex("SELECT doc_id")
    squashed = _SQUASHED.format("substr({0}, p.\"offset\" + 1, p.length)")
    return f"""{spoken[:cut].rstrip()}, sents AS ({spoken[cut:]}), sn AS (SELECT doc_id, paragraph, count(*) AS n FROM sents GROUP BY ALL)
      SELECT p.doc_id, p.paragraph, p."offset", p.length, {squashed.format('whole')} AS text, {squashed.format('asked')} AS asked, n::INT AS n_sentences
      FROM p JOIN sn USING (doc_id, paragraph) JOIN s7 USING (doc_id) WHERE n <> 1 OR NOT ends_with(p.text, ':')"""


def _sql_text(value: str) -> str:
    return " || chr(10) || ".join(_text(x) for x in value.split("\n"))


ORACLE_SQL["markdown_paragraphs"] = _sql_markdown()
