"""Queries over the driver's tables. The texts hold none of the phrases, so each document has one more paragraph, by its id:
a sentence of our own for or against a rule, the same in Spark and in SQL. The SQL of a rule is derived from the rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID, RULES, Rule, catalog, select_rules
from tellscan.functions.examples import CASES
from tellscan.operators.calibrate import auc
from tellscan.operators.corpus import chosen, common, lacking
from tellscan.operators.intervals import overlapping
from tellscan.operators.judge import settle
from tellscan.operators.report import json_by_document
from tellscan.operators.scan import MARKDOWN_NOISE, all_spans, blank_markdown, counts, folded, n_notes, scan
from tellscan.operators.split import paragraphs, sentences, split
from tellscan.plans.rule_sql import NONE, echo_counts, is_plain, sql_count, sql_notes, sql_spans

DEFAULT = select_rules()
SENTENCES = [t for pair in CASES.values() for t in pair]
#: How many documents of a rule, source and side are shown.
FIRST = 5
#: Fixed value: words in a row that two texts may not share.
SHINGLE = 6


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt to all cores if the files give fewer parts than there are: a large table, in many parts, is never moved for a scan."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, each with one more paragraph: an example or a counterexample of a rule, by id."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    added = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod("doc_id", F.lit(len(SENTENCES))) + 1).cast("int"))
    return docs.withColumn("text", F.concat("text", F.lit("\n\n"), added))


def with_side(rows: DataFrame, sf_dir: str) -> DataFrame:
    """rows, which have doc_id, with a side: what the labels say of the document's quality, or none. No text goes into the join."""
    labels = rows.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label"))
    return rows.join(labels, "doc_id", "left").withColumn("side", F.coalesce("label", F.lit("none"))).drop("label")


_ADDED = ", ".join("'" + t.replace("'", "''") + "'" for t in SENTENCES)
SQL_DOCUMENTS = f"d AS (SELECT doc_id, lang, source, text || chr(10) || chr(10) || ([{_ADDED}])[(doc_id % {len(SENTENCES)} + 1)::INT] AS text FROM documents)"
SQL_SIDED = f"{SQL_DOCUMENTS}, e AS (SELECT d.*, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'none' END AS side FROM d LEFT JOIN labels USING (doc_id))"


def rule_query(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts(documents(spark, sf_dir), [BY_ID[rule]]).select("doc_id", F.col("n").alias("n_notes"))

    return run


def _total(rules: Sequence[Rule]) -> Column:
    return sum((n_notes(F.col("text"), r, F.col("low")) for r in rules), F.lit(0)).cast("long")


def notes_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_notes, n_errors for every document, of all rules that aren't low; those without notes are included."""
    docs = documents(spark, sf_dir).withColumn("low", folded(F.col("text")))
    parts = {s: [r for r in DEFAULT if (r.severity == "error") == s] for s in (True, False)}
    counted = docs.select("doc_id", _total(parts[True]).alias("n_errors"), _total(parts[False]).alias("others"))
    return counted.select("doc_id", (F.col("n_errors") + F.col("others")).alias("n_notes"), "n_errors")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, words, notes of all rules that aren't low."""
    docs = documents(spark, sf_dir).withColumn("low", folded(F.col("text")))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x09-\x0D ]+")), F.lit(0))
    return docs.select("doc_id", "source", words.cast("long").alias("words"), _total(DEFAULT).alias("notes"))


def notes_per_1k_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, side, words, notes, per_1k: notes of all rules that aren't low for each thousand words."""
    got = with_side(_rated(spark, sf_dir), sf_dir).groupBy("source", "side").agg(F.sum("words").alias("words"), F.sum("notes").alias("notes"))
    return got.withColumn("per_1k", F.when(F.col("words") > 0, F.round(1000 * F.col("notes") / F.col("words"), 6)).otherwise(F.lit(0.0)))


def _first(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with place: the FIRST least of each group. The limit on row_number() keeps no more of a group in a part before the groups meet."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= FIRST)


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, source, side, place, doc_id, n: the first FIRST documents with notes of each rule, source and side."""
    docs = documents(spark, sf_dir).withColumn("low", folded(F.col("text")))
    hits = F.array(*[F.struct(F.lit(r.id).alias("rule"), n_notes(F.col("text"), r, F.col("low")).cast("long").alias("n")) for r in DEFAULT])
    each = docs.select("doc_id", "source", F.inline(F.filter(hits, lambda h: h["n"] > 0)))
    return _first(with_side(each, sf_dir), ["rule", "source", "side"], ["doc_id", "n"]).select("rule", "source", "side", "place", "doc_id", "n")


def first_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, side, place, doc_id, line, column, context: the first FIRST notes of each rule and side."""
    found = scan(documents(spark, sf_dir), DEFAULT).select("rule", "doc_id", "line", "column", "context")
    return _first(with_side(found, sf_dir), ["rule", "side"], ["doc_id", "line", "column", "context"]).select("rule", "side", "place", "doc_id", "line", "column", "context")


def first_plain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_notes() of the rules whose matches SQL can place."""
    found = scan(documents(spark, sf_dir), PLAIN).select("rule", "doc_id", "line", "column", "context")
    return _first(with_side(found, sf_dir), ["rule", "side"], ["doc_id", "line", "column", "context"]).select("rule", "side", "place", "doc_id", "line", "column", "context")


def all_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), list(RULES))


def plain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rule, line, column, excerpt, context, count: the notes of the rules whose matches SQL can place."""
    return scan(documents(spark, sf_dir), PLAIN).select("doc_id", "rule", "line", "column", "excerpt", "context", "count", "message")


#: Rules that need no look-around but for their gaps.
PLAIN = [r for r in RULES if r.id not in NONE and is_plain(r)]


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the number of documents that each rule notes something in; null for rules that are off by default."""
    docs = documents(spark, sf_dir).withColumn("low", folded(F.col("text")))
    hits = docs.agg(*[F.count_if(n_notes(F.col("text"), r, F.col("low")) > 0).alias(r.id) for r in DEFAULT])
    each = hits.select(F.inline(F.array(*[F.struct(F.lit(r.id).alias("id"), F.col(f"`{r.id}`").alias("n_documents")) for r in DEFAULT])))
    return catalog(spark).join(each, "id", "left")


def blanked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", blank_markdown(F.col("html")).alias("blanked"))


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_paragraphs"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, offset, length, text of the blocks between blank lines."""
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "p"))
    return found.select("doc_id", "paragraph", "p.offset", "p.length", "p.text")


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, sentence, offset, length, text of the sentences of the blocks between blank lines."""
    found = F.transform(paragraphs(F.col("text")), lambda p: sentences(p["text"], p["offset"]))
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(found).alias("paragraph", "s"))
    return each.select("doc_id", "paragraph", F.posexplode("s").alias("sentence", "x")).select("doc_id", "paragraph", "sentence", "x.offset", "x.length", "x.text")


def note_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rule, off, paragraph, sentence: the sentences that each note of the rules that SQL can place touches."""
    found = documents(spark, sf_dir).withColumn("low", folded(F.col("text"))).select("doc_id", F.inline(all_spans(F.col("text"), PLAIN, F.col("low"))))
    names = F.array(*[F.lit(r.id) for r in PLAIN])
    notes = found.select("doc_id", F.get(names, F.col("ord")).alias("rule"), "off", (F.col("off") + F.length("m")).alias("end"))
    spoken = sentence_spans(spark, sf_dir).select("doc_id", "paragraph", "sentence", F.col("offset").alias("from"), (F.col("offset") + F.col("length")).alias("to"))
    return overlapping(notes, spoken, left_span=("off", "end")).select("doc_id", "rule", "off", "paragraph", "sentence")


def paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, sentence, offset, length, text, asked: the sentences of the split, after furniture was blanked."""
    found = split(documents(spark, sf_dir))
    return found.select("doc_id", "paragraph", F.posexplode("sentences").alias("sentence", "x")).select("doc_id", "paragraph", "sentence", "x.*")


def notes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_by_document(scan(documents(spark, sf_dir), select_rules()))


def quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well notes for each thousand words tell bad documents from good, by source."""
    # counted once and written: else a filter on the rate would count all rules again, below the exchange that deals out the texts
    sided = with_side(settle(_rated(spark, sf_dir)), sf_dir).where("side <> 'none'")
    rated = sided.select("source", (F.col("side") == "bad").alias("bad"), F.when(F.col("words") > 0, F.round(1000 * F.col("notes") / F.col("words"), 6)).alias("rate"))
    return auc(rated, "source", "rate", "bad")


def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang: what documents labelled good and documents labelled bad both come in."""
    docs = with_side(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang"), sf_dir)
    return common(chosen(docs, side="good"), chosen(docs, side="bad"), "source", "lang")


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that no label is about."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return lacking(docs, labels, "doc_id")


def note_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, n_rules, n_notes over all rules that aren't low."""
    docs = documents(spark, sf_dir).withColumn("low", folded(F.col("text")))
    each = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.id).alias("rule"), n_notes(F.col("text"), r, F.col("low")).cast("long").alias("n")) for r in DEFAULT])
    found = docs.select(F.inline(F.filter(each, lambda h: h["n"] > 0))).groupBy("category", "rule").agg(F.sum("n").alias("n"))
    return found.groupBy("category").agg(F.count("*").alias("n_rules"), F.sum("n").alias("n_notes"))


def shared_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shared: how many different runs of SHINGLE words a document has in common with any benchmark item."""

    def runs(table: str, key: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x09-\x0D ]+"), F.lit(0))
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, words.alias("w")).where(F.size("w") >= SHINGLE)
        return rows.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("w", i, SHINGLE), " ")))).alias("run"))

    return runs("documents", "doc_id").join(runs("benchmark", "item_id").select("run").distinct(), "run", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"rule_{r.id.replace('-', '_')}": rule_query(r.id) for r in RULES},
    "notes_by_document": notes_by_document,
    "notes_per_1k_words": notes_per_1k_words,
    "first_hits": first_hits,
    "first_notes": first_notes,
    "first_plain_notes": first_plain_notes,
    "all_notes": all_notes,
    "plain_notes": plain_notes,
    "rule_catalog": rule_catalog,
    "blanked_pages": blanked_pages,
    "paragraph_counts": paragraph_counts,
    "paragraph_spans": paragraph_spans,
    "sentence_spans": sentence_spans,
    "note_sentences": note_sentences,
    "paragraph_sentences": paragraph_sentences,
    "notes_as_json": notes_as_json,
    "quality_auc": quality_auc,
    "shared_sources": shared_sources,
    "unlabelled": unlabelled,
    "note_categories": note_categories,
    "shared_shingles": shared_shingles,
}
_ALL = " + ".join(f"n{k}" for k, _ in enumerate(DEFAULT))
_ERRORS = " + ".join(f"n{k}" for k, r in enumerate(DEFAULT) if r.severity == "error")
_COUNTS = ", ".join(f"{sql_count(r)} AS n{k}" for k, r in enumerate(DEFAULT))
_PARAGRAPHS = f"""WITH {SQL_DOCUMENTS}, x AS (SELECT doc_id, string_split(regexp_replace(text, '\\r?\\n[ \\t\\x{{00A0}}]*\\r?\\n', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS x FROM d WHERE text IS NOT NULL),
      y AS (SELECT doc_id, i, x[i] AS piece, length(replace(array_to_string(x[1:i - 1], ''), chr(2), '')) AS base FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM x)),
      z AS (SELECT doc_id, i, CASE WHEN i > 1 THEN split_part(piece, chr(2), 2) ELSE piece END AS body, base + CASE WHEN i > 1 THEN length(split_part(piece, chr(2), 1)) ELSE 0 END AS base FROM y),
      t AS (SELECT doc_id, i, base + length(body) - length(regexp_replace(body, '\\A[\\s\\v\\x00]+', '')) AS "offset", regexp_replace(body, '\\A[\\s\\v\\x00]+|[\\s\\v\\x00]+\\z', '', 'g') AS text FROM z),
      p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS paragraph, "offset"::INT AS "offset", length(text)::INT AS length, text FROM t WHERE text <> '')"""
#: Fixed value: split.GOES_ON without look-behind.
_GOES_ON = r"\b(?:e\.g|i\.e|vs|etc|cf|Fig|No|Dr|Mr|Mrs|Ms|St|Inc|Ltd|Sec|Ch|Vol)\.\z|(?:\A|[^\pL])(?:\pL\.){2,6}\z|\A\d+\.\z"
ORACLE_SQL: dict[str, str] = {
    **{f"rule_{r.id.replace('-', '_')}": f"WITH {SQL_DOCUMENTS} SELECT doc_id, {sql_count(r)} AS n_notes FROM d" for r in RULES if r.id not in NONE},
    "rule_phrase_echo": f"WITH {SQL_DOCUMENTS}, {echo_counts()}",
    "notes_by_document": f"WITH {SQL_DOCUMENTS}, c AS (SELECT doc_id, {_COUNTS} FROM d) SELECT doc_id, {_ALL} AS n_notes, {_ERRORS} AS n_errors FROM c",
    "notes_per_1k_words": f"WITH {SQL_SIDED}, c AS (SELECT source, side, coalesce(len(regexp_extract_all(text, '[^\x09-\x0D ]+')), 0) AS w, {_COUNTS} FROM e), s AS (SELECT source, side, sum(w)::BIGINT AS words, sum({_ALL})::BIGINT AS notes FROM c GROUP BY source, side) SELECT source, side, words, notes, CASE WHEN words > 0 THEN round(1000 * notes / words, 6) ELSE 0 END AS per_1k FROM s",
    "first_hits": f"WITH {SQL_SIDED}, h AS (" + " UNION ALL ".join(f"SELECT '{r.id}' AS rule, source, side, doc_id, {sql_count(r)} AS n FROM e" for r in DEFAULT) + f"), p AS (SELECT *, row_number() OVER (PARTITION BY rule, source, side ORDER BY doc_id)::INT AS place FROM h WHERE n > 0) SELECT rule, source, side, place, doc_id, n FROM p WHERE place <= {FIRST}",
    "first_plain_notes": f"WITH {SQL_SIDED}, h AS (" + " UNION ALL ".join(sql_notes(r) for r in PLAIN) + f"), p AS (SELECT h.*, side, row_number() OVER (PARTITION BY rule, side ORDER BY doc_id, line, \"column\", context)::INT AS place FROM h JOIN e USING (doc_id)) SELECT rule, side, place, doc_id, line, \"column\", context FROM p WHERE place <= {FIRST}",
    "plain_notes": f"WITH {SQL_DOCUMENTS} " + " UNION ALL ".join(sql_notes(r) for r in PLAIN),
    "rule_catalog": f"WITH {SQL_DOCUMENTS}, n AS (" + " UNION ALL ".join(f"SELECT '{r.id}' AS id, count(*) FILTER ({sql_count(r)} > 0) AS n_documents FROM d" for r in DEFAULT) + ") SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([f"{i}::INT", *("NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'" for v in (r.id, r.category, r.severity, r.confidence, r.message, r.suggestion, r.rationale))]) + ")" for i, r in enumerate(RULES)) + ") t(ord, id, category, severity, confidence, message, suggestion, rationale) LEFT JOIN n USING (id)",
    "blanked_pages": f"SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(html, '{MARKDOWN_NOISE.replace('(?md)', '(?m)')}', chr(1) || '\\0' || chr(2), 'g'), chr(1)), lambda x: CASE WHEN contains(x, chr(2)) THEN regexp_replace(split_part(x, chr(2), 1), '[^\\n]', ' ', 'g') || split_part(x, chr(2), 2) ELSE x END), '') AS blanked FROM pages",
    "paragraph_spans": f"{_PARAGRAPHS} SELECT * FROM p",
    "sentence_spans": f"""{_PARAGRAPHS},
      m AS (SELECT doc_id, paragraph, "offset" AS base, string_split(regexp_replace(text, '([.!?]["''”’)\\]]?)(\\s+)(["''“‘(\\[A-Z0-9])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS x FROM p),
      n AS (SELECT doc_id, paragraph, base + length(replace(array_to_string(x[1:i - 1], ''), chr(2), '')) AS pos, i, CASE WHEN i > 1 THEN split_part(x[i], chr(2), 1) ELSE '' END AS gap, CASE WHEN i > 1 THEN split_part(x[i], chr(2), 2) ELSE x[i] END AS body FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM m)),
      o AS (SELECT *, coalesce(lag(regexp_matches(body, '{_GOES_ON}')) OVER (PARTITION BY doc_id, paragraph ORDER BY i), FALSE) AS goes_on FROM n),
      q AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, paragraph ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS sentence FROM o),
      r AS (SELECT doc_id, paragraph, sentence, min(pos + length(gap)) AS "offset", string_agg(CASE WHEN goes_on THEN gap || body ELSE body END, '' ORDER BY i) AS raw FROM q GROUP BY doc_id, paragraph, sentence)
      SELECT doc_id, paragraph, sentence::INT AS sentence, "offset"::INT AS "offset", length(raw)::INT AS length, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' ') AS text FROM r""",
    "paragraph_counts": f"WITH {SQL_DOCUMENTS} SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(text, '\\r?\\n[ \\t\\x{{00A0}}]*\\r?\\n'), lambda p: regexp_matches(p, '[^ \\t\\n\\v\\f\\r]'))), -1)::BIGINT AS n_paragraphs FROM d",
    "quality_auc": f"WITH {SQL_SIDED}, c AS (SELECT source, side = 'bad' AS bad, coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D ]+')), 0) AS w, {_COUNTS} FROM e WHERE side <> 'none'), j AS (SELECT source, bad, round(1000 * ({_ALL}) / w, 6) AS score FROM c WHERE w > 0), r AS (SELECT source, bad, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM j), s AS (SELECT source, count(*) FILTER (bad) AS n_pos, count(*) FILTER (NOT bad) AS n_neg, sum(r) FILTER (bad) AS ranks FROM r GROUP BY source) SELECT source, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9)::DOUBLE END AS auc FROM s",
    "note_categories": f"WITH {SQL_DOCUMENTS}, h AS (" + " UNION ALL ".join(f"SELECT '{r.category}' AS category, '{r.id}' AS rule, sum({sql_count(r)})::BIGINT AS n FROM d" for r in DEFAULT) + ") SELECT category, count(*) AS n_rules, sum(n)::BIGINT AS n_notes FROM h WHERE n > 0 GROUP BY category",
    "shared_shingles": " ".join(f"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x09-\\x0D ]+') AS w FROM documents), b AS (SELECT regexp_extract_all(lower(text), '[^\\x09-\\x0D ]+') AS w FROM benchmark),
      x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM a WHERE len(w) >= {SHINGLE})),
      y AS (SELECT DISTINCT array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS run FROM (SELECT w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM b WHERE len(w) >= {SHINGLE}))
      SELECT doc_id, count(*) AS n_shared FROM x JOIN y USING (run) GROUP BY doc_id""".split()),
}
_SPOKEN = ORACLE_SQL["sentence_spans"]
# the documents have no furniture, so what is split is what stands there
ORACLE_SQL["paragraph_sentences"] = f"{_SPOKEN[: _SPOKEN.rindex('SELECT doc_id')].rstrip()}, sents AS ({_SPOKEN[_SPOKEN.rindex('SELECT doc_id') :]}) SELECT *, text AS asked FROM sents"
ORACLE_SQL["note_sentences"] = f"""{_SPOKEN[: _SPOKEN.rindex("SELECT doc_id")].rstrip()},
      sents AS ({_SPOKEN[_SPOKEN.rindex("SELECT doc_id") :]}),
      spans AS ({" UNION ALL ".join(sql_spans(r) for r in PLAIN)})
      SELECT doc_id, rule, off, paragraph, sentence FROM spans JOIN sents USING (doc_id) WHERE off < "offset" + length AND "end" > "offset\""""
ORACLE_SQL["shared_sources"] = "SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 INTERSECT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0"
ORACLE_SQL["unlabelled"] = "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels"
