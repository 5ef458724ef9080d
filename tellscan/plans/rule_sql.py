"""The pattern rules as SQL, derived from the catalogue, for an engine whose patterns have no look-around and no back-references.

A pattern is taken without its look-arounds, and its matches are marked in the text; what the look-arounds at its ends
ask for becomes a condition on a match, on what follows it or on what comes before it. WITHIN has the conditions that
stand for look-arounds and back-references inside patterns. Where a match needs a character that another has taken, or
a gap that may not hold a blank line, the SQL is looser than the rule; on the queries' tables both count the same.
"""

from __future__ import annotations

import re

from tellscan.functions import guarded as g
from tellscan.functions.catalog import BY_ID, Rule
from tellscan.functions.literals import alternatives, group_end

#: A gap with at most one line break, where the rules' loops look ahead for a blank line.
ONE_BREAK = r"(?:[ \t]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
GAPS = (g.NB, g.GAP, g.WRAP, g.INDENT)
#: Rules that SQL can't count in one expression: phrase-echo has a statement of its own, echo_counts().
NONE = ("phrase-echo",)
M, AFTER, BEFORE = "m", "a", "b"
#: Stands after a full stop, a question or an exclamation mark, so that one match may take the stop and the next one this.
STOP = r"\x03"


def plain(p: str) -> str:
    """p without look-around, possessive loops and atomic groups; a look-behind for a character becomes that character."""
    for gap in GAPS:
        p = p.replace(gap, ONE_BREAK)
    p = p.replace(r"\p{IsAlphabetic}", r"\pL").replace(r"\p{IsWhite_Space}", r"\s").replace(r"\G", "").replace(g.LETTER, r"\pL\pM\p{Nd}\p{Pc}")
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\":
            j = p.index("}", i) + 1 if p[i : i + 3] == r"\p{" else i + 2
            out.append(p[i:j])
        elif p[i] == "[":
            j = group_end(p, i)
            out.append(p[i:j])
        elif p.startswith(("(?=", "(?!", "(?<!"), i):
            j = group_end(p, i)
        elif p.startswith("(?<=", i):
            j = group_end(p, i)
            out.append(f"(?:{p[i + 4 : j - 1]})")
        elif p.startswith("(?>", i):
            j = i + 3
            out.append("(?:")
        else:
            j = i + 2 if p[i] in "*+?}" and p[i + 1 : i + 2] == "+" else i + 1
            out.append(p[i])
        i = j
    return "".join(out)


def _ends(p: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """p without the look-arounds at its ends, and these as (what to look at, pattern, wanted)."""
    found = []
    while len(alternatives(p)) == 1:
        skip = 2 if p.startswith(r"\b") else 0
        body = p[skip:]
        if body.startswith(("(?=", "(?!")):
            end = group_end(body, 0)
            found.append((f"{M} || {AFTER}", f"^(?:{plain(body[3 : end - 1])})", body[2] == "="))
            p = p[:skip] + body[end:]
        elif body.startswith("(?<!"):
            end = group_end(body, 0)
            found.append((BEFORE, f"(?:{plain(body[4 : end - 1])})$", False))
            p = p[:skip] + body[end:]
        else:
            starts = [i for i in range(len(p)) if p.startswith(("(?=", "(?!"), i) and group_end(p, i) == len(p)]
            if not starts:
                break
            i = starts[0]
            found.append((AFTER, f"^(?:{plain(p[i + 3 : -1])})", p[i + 2] == "="))
            p = p[:i]
    return p, found


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _holds(what: str, pattern: str, wanted: bool = True, flags: str = "(?i)") -> str:
    return f"{'' if wanted else 'NOT '}regexp_matches({what}, {_quoted(flags + pattern)})"


def _group(pattern: str, n: int, flags: str = "(?i)") -> str:
    return f"lower(regexp_extract({M}, {_quoted(flags + pattern)}, {n}))"


def _among(words: str, value: str, wanted: bool = False) -> str:
    return _holds(value, f"^(?:{words})$", wanted)


def _inside(p: str, opening: str, n: int = 0) -> str:
    """What the n-th group of p with this opening holds."""
    at = -1
    for _ in range(n + 1):
        at = p.index(opening, at + 1)
    return plain(p[at + len(opening) : group_end(p, at) - 1])


W = r"[\w'’-]+"


def _for_each(rule: str, opening: str) -> str:
    """The rule's pattern once for each of the words that a back-reference repeats."""
    p = BY_ID[rule].pattern
    i = p.index(opening)
    end = group_end(p, i)
    return "|".join(f"(?:{p[:i]}{w}{p[end:]})".replace(r"\3", w) for w in alternatives(p[i + 1 : end - 1]))


def _without(p: str, opening: str) -> str:
    i = p.index(opening)
    return p[:i] + p[group_end(p, i) :]


#: Patterns whose back-references are spelt out for each word, or become a second group that WITHIN compares. Their words are fixed values, as the rules have them.
SPELT = {
    "epistrophe": rf"\b{W}{g.GAP}[\w'’-]{{4,}},{g.GAP}[^.,;:!?]{{5,140}}[.!?]",
    "the-x-is-the-x": BY_ID["the-x-is-the-x"].pattern.replace(r"\3", f"(?:{g.HEADS})"),
    "the-x-is-not-the-x": BY_ID["the-x-is-not-the-x"].pattern.replace(r"\3", r"\pL{2,}"),
    "dont-verb-it": BY_ID["dont-verb-it"].pattern.replace(r"\3", r"\w+"),
    "rule-of-three": r"[\w'-]+,\s+[\w'-]+,\s+(?:and\s+)?[\w'-]+[.!?]",
    "actually-not-x": r"\bactually\b[^.;:!?,\n]{0,120},[ \t]*not\b",
    "short-run": BY_ID["short-run"].pattern.replace(g.SHORT, r"""[A-Za-z](?:[^.!?\n"“”0-9]{1,27}[A-Za-z'’][A-Za-z]|[^.!?\n"“”0-9]{2,28}[^.!?\n"“”0-9A-Za-z])\."""),
    "same-determiner-chain": _for_each("same-determiner-chain", "(every|"),
    "not-by-x-but-by-y": _for_each("not-by-x-but-by-y", "(by|").replace(g.GAP, ONE_BREAK),
    "negative-subject": _without(BY_ID["negative-subject"].pattern, "(?<=\\A"),
}
#: Their prefixes only say what comes before, which a condition does as well.
NO_PREFIX = {"rule-of-three": r"(?:^|[^,\s])\s*$", "actually-not-x": r"(?:^|[.;:!?\n])[^.;:!?,\n]{0,200}$"}
_pattern = {i: r.pattern for i, r in BY_ID.items()}
_last_two, _first_two = rf"({W})\s+({W})[.!?]$", rf"^({W})\s+({W}),"
#: Conditions for look-arounds and back-references inside a pattern. Their words are fixed values, as the rules have them.
WITHIN: dict[str, list[str]] = {
    "honest-x": [_holds(M, r"^\w+[ \t]+(?:most|more)[ \t]+honest", False)],
    "most-honest-x": [f"({_holds(M, r'honest[ ]way[ ]to')} OR {_holds(M, r'[ ]way[ ]', False)})"],
    "thats-the-whole": [f"({_holds(M, r'(?:value|fix)$', False)} OR {_holds(AFTER, '^(?:' + _inside(g.CLOSERS, '(?=').replace('(?:' + chr(92) + 'z', '(?:$') + ')')})"],
    "is-the-whole-x": [_holds(M, r"entire\s+(?:point|game|thing|deal|story)$", False)],
    "epistrophe": [f"{_group(_last_two, n)} = {_group(_first_two, n)}" for n in (1, 2)] + [_among("the|a|an", _group(_first_two, 1))],
    "the-x-is-the-x": [f"{_group(rf'^the{chr(92)}s+({g.HEADS}){chr(92)}b', 1)} = {_group(rf'({g.HEADS})$', 1)}"],
    "the-x-is-not-the-x": [f"{_group(r'^the\s+(\pL{2,})', 1)} = {_group(r'(\pL{2,})$', 1)}", _among(f"{g.HEADS}|same", _group(r"(\pL{2,})$", 1))],
    "dont-verb-it": [f"{_group(r'^(?:dont|don.t|do\s+not)\s+(\w+)', 1)} = {_group(r'(\w+)\s+it$', 1)}"],
    "real-x-real-y": [_among(g.REAL_NEXT, _group(rf"^real[ \t]+({W})", 1)), _among(g.REAL_NEXT, _group(rf"real[ \t]+({W})$", 1)), f"{_group(rf'^real[ ]+({W})', 1)} <> {_group(rf'real[ ]+({W})$', 1)}", _holds(M, "real-", False)],
    "exact-exactly": [f"({_holds(M, r'^(?:that|this|it|these|those|which)', False)} OR {_holds(AFTER, '^' + _inside(_pattern['exact-exactly'], '(?!'), False)})"],
    "impact-verb": [f"({_holds(M, r'^to\s+impacts?$', False)} OR ({_holds(AFTER, r'^\s+\w')} AND {_holds(AFTER, r'^\s+(?:and|or|but|in|on|at|of|for|from|with|during|after|before|than)\b', False)}))"],
    "cataphoric-teaser": [f"({_holds(M, r'(?:here.?s|here\s+is|this\s+is)\s')} OR {_holds(M, r'^[.!?:\s]*[A-Z]', True, '')})"],
    "actually-not-x": [_holds(M, r"[\pL\pM\p{Nd}\p{Pc}],[ \t]*not$")],
    "not-x-but-y": [_holds(M, rf"\bnot\s+(?:{_inside(_pattern['not-x-but-y'], '(?!')})", False), _holds(M, rf"\bbut\s+(?:rather\s+)?(?:{_inside(g.NOT_CORRECTED, '(?!')})", False)],
    "isnt-x-its-y": [_holds(M, rf"^[\w'’]+(?:\s+not)?\s+{g.ARTICLE}(?:{_inside(g.NOT_REPLACED, '(?!')})", False), _holds(M, rf"\s{g.ARTICLE}(?:{_inside(g.NOT_REPLACED, '(?!')})$", False)],
    "not-by-x-but-by-y": [_among("that|this|it|him|her|them|me|us|you|which|whom|what", _group(rf"({W})$", 1))],
    "everyone-nobody": [_holds(M, r",[ \t]+none[ \t]+(?:of|more|less|so)\b", False), _holds(M, r",[ \t]+one[ \t]+(?:of|by|per|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|miles?)\b", False)],
    "np-fragment-and": [_holds(M, r"\s(?:is|are|was|were|be|been|being|am|has|have|had|having|does|do|did|can|could|will|would|shall|should|must|may|might|ought|ain|\w+n['’]t)[\s.,]", False)],
    "quip-question": [_holds(M, r"\s(?:is|are|was|were|has|have|had|do|does|did|can|could|will|would|should|must|may|might|am|\w+n['’]t)[\s?]", False)],
    "trailing-significance-participle": [_holds(M, r"^\w*ing,", False), _holds(M, r",[ \t]+(?:further[ \t]+|thereby[ \t]+|thus[ \t]+|ultimately[ \t]+)?\w+[ \t]+[,ao]$", False)],
    "trailing-restatement": [f"({_holds(M, r'^,\s+making', False)} OR {_holds(AFTER, r'^(?:\s+(?:to|for|than)\b|[ \t]*[.,;:!?)]|[ \t]*\r?\n|[ \t]*$)')})"],
    "rule-of-three": [_holds(BEFORE, r"[\w'-]$", False)],
}


def sql_pattern(rule: Rule) -> tuple[str, str, str, list[str]]:
    """Flags, prefix and pattern to mark, and the conditions on the matches."""
    body, ends = _ends(SPELT.get(rule.id, rule.pattern))
    before = NO_PREFIX.get(rule.id)
    flags = "(?im)" if rule.ignore_case else "(?m)"
    own = "(?i)" if rule.ignore_case else ""
    conditions = [_holds(what, p, wanted, own) for what, p, wanted in ends] + WITHIN.get(rule.id, [])
    conditions += [_holds(BEFORE, before)] if before else []
    conditions += [_holds(M, plain(skip), False, "") for skip in rule.skip if r"\1" not in skip]
    if rule.id == "from-x-to-y-chain":  # a chain that goes on from where it came to, and a range of one thing, are skipped
        conditions.append(f"{_group(rf'to\s+(?:[\w-]+\s+){{0,2}}?({W}),\s+(?:and\s+)?from\s', 1)} <> {_group(rf',\s+(?:and\s+)?from\s+(?:[\w-]+\s+){{0,2}}?({W})\s+to\s', 1)}")
        conditions.append(f"{_group(rf'^from\s+(?:the\s+)?({W})\s+to\s', 1)} <> {_group(rf'^from\s+(?:the\s+)?{W}\s+to\s+(?:the\s+)?({W})', 1)}")
    prefix, body = "" if before else plain(rule.prefix), plain(body)
    if _goes_on(rule):
        prefix = prefix.replace(r"(?:[.!?])", STOP).replace(r"[.!?][ \t]", rf"[.!?]{STOP}[ \t]")
        body = body.replace(r"\.", rf"\.{STOP}??")
    return flags, prefix, f"(?:{body})", conditions


def _goes_on(rule: Rule) -> bool:
    """Whether a note may begin at the very stop that ends the one before it: STOP is put after each stop then."""
    return "(?<=[.!?])" in rule.prefix and rule.id not in NO_PREFIX


def is_plain(rule: Rule) -> bool:
    """Whether SQL can place the rule's matches, too."""
    body = rule.pattern
    for gap in GAPS:
        body = body.replace(gap, "")
    return not (rule.skip or rule.prefix or rule.id in SPELT or re.search(r"\(\?<?[=!]", body))


def sql_count(rule: Rule, text: str = "text") -> str:
    """How many notes of the rule a text has, as an SQL expression."""
    flags, prefix, body, conditions = sql_pattern(rule)
    if _goes_on(rule):
        text = f"regexp_replace({text}, '([.!?])', '\\1' || chr(3), 'g')"
    if not conditions:
        return f"coalesce(len(regexp_extract_all({text}, {_quoted(flags + prefix + body)})), 0)::BIGINT"
    whole = "split_part(x[i], chr(2), 1)"
    match = f"regexp_extract({whole}, {_quoted(f'{flags[:-1]}s)^{prefix}({body})$')}, 1)" if prefix else whole
    names = {
        M: f"translate({match}, chr(3), '')",
        AFTER: "translate(split_part(x[i], chr(2), 2) || array_to_string(x[i + 1:], ''), chr(2) || chr(3), '')",
        BEFORE: "translate(x[i - 1]" + (f" || left({whole}, length({whole}) - length({match}))" if prefix else "") + ", chr(2) || chr(3), '')",
    }
    each = " AND ".join(conditions)
    each = re.sub(r"(?<=\()(?:m \|\| a|m|a|b)(?=, ')", lambda k: " || ".join(names[w] for w in k[0].split(" || ")), each)
    marked = f"string_split(regexp_replace({text}, {_quoted(flags + prefix + body)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"coalesce(list_sum(list_transform([{marked}], lambda x: len(list_filter(range(2, len(x) + 1), lambda i: {each})))), 0)::BIGINT"


#: Fixed values of the scan: context on each side of a match, and the length of a match that needs none.
_SIDE, _ALONE = 40, 40
_SQUASH = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"


def _sql_placed(rule: Rule, table: str) -> str:
    """doc_id, text, pre, m, post of each match of a rule without conditions."""
    flags, _, body, _ = sql_pattern(rule)
    marked = f"string_split(regexp_replace(text, {_quoted(flags + body)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    pieces = f"SELECT doc_id, text, x, unnest(range(2, len(x) + 1)) AS i FROM (SELECT doc_id, text, {marked} AS x FROM {table})"
    return f"SELECT doc_id, text, replace(array_to_string(x[1:i - 1], ''), chr(2), '') AS pre, split_part(x[i], chr(2), 1) AS m, replace(split_part(x[i], chr(2), 2) || array_to_string(x[i + 1:], ''), chr(2), '') AS post FROM ({pieces})"


def sql_spans(rule: Rule, table: str = "d") -> str:
    """doc_id, rule, off, end of the matches of a rule without conditions."""
    return f'SELECT doc_id, {_quoted(rule.id)} AS rule, length(pre)::INT AS off, (length(pre) + length(m))::INT AS "end" FROM ({_sql_placed(rule, table)})'


def sql_notes(rule: Rule, table: str = "d") -> str:
    """doc_id, rule, line, column, excerpt, context, count, message of the notes of a rule without conditions, as SQL over a table of texts."""
    if not is_plain(rule):
        raise ValueError(f"SQL can't place the matches of {rule.id}")
    placed = _sql_placed(rule, table)
    before = f"CASE WHEN length(pre) > {_SIDE} THEN '…' || regexp_replace(right(pre, {_SIDE}), '\\A\\S*\\s+', '') ELSE pre END"
    after = f"CASE WHEN length(post) > {_SIDE} THEN regexp_replace(left(post, {_SIDE}), '\\s\\S*\\z', '') || '…' ELSE post END"
    context = f"CASE WHEN length(m) >= {_ALONE} THEN '[' || {_SQUASH.format('m')} || ']' ELSE {_SQUASH.format(f'({before} || m || {after})')} END"
    count = f"len(regexp_extract_all(m, {_quoted(rule.count_group)}))::INT" if rule.count_group else "NULL::INT"
    message = f"replace({_quoted(rule.message)}, '%{{count}}', ({count})::VARCHAR)" if rule.count_group else _quoted(rule.message)
    line, column = "length(pre) - length(replace(pre, chr(10), '')) + 1", "length(string_split(pre, chr(10))[-1]) + 1"
    return f'SELECT doc_id, {_quoted(rule.id)} AS rule, ({line})::INT AS line, ({column})::INT AS "column", {_SQUASH.format("m")} AS excerpt, {context} AS context, {count} AS count, {message} AS message FROM ({placed})'


def echo_counts(table: str = "d") -> str:
    """doc_id, n_notes of phrase-echo for every row of a table of texts, as common table expressions and a SELECT.

    A text is cut into words that hold together by quotes and hyphens. A phrase is three of these, and the next equal
    phrase that stands clear is looked up by an as-of join; words, bad gaps and notes are counted along the text.
    """
    letter = r"\pL\pM\p{Nd}\p{Pc}"
    gap = r"^(?:[ \t\x{00A0}]{1,2}|\r?\n[ \t\x{00A0}]{0,4})$"
    mark = "'’-"
    quoted = mark.replace("'", "''")
    word, six = f"^[a-z][0-9A-Za-z_{quoted}]{{3,}}$", "^[a-z]{6,}$"
    steps = 400
    return f"""e1 AS (SELECT doc_id, string_split(regexp_replace(text, '[{letter}{quoted}]+', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS x FROM {table}),
      e2 AS (SELECT doc_id, k, split_part(x[k], chr(2), 1) AS w, CASE WHEN k > 2 THEN split_part(x[k - 1], chr(2), 2) ELSE x[1] END AS g, CASE WHEN k > 2 THEN split_part(x[k - 1], chr(2), 1) ELSE '' END AS prior
        FROM (SELECT doc_id, x, unnest(range(2, len(x) + 1)) AS k FROM e1)),
      e3 AS (SELECT doc_id, k, w, g, len(regexp_extract_all(w, '[{letter}]+')) AS n, regexp_extract(prior, '[{quoted}]*$') || g || regexp_extract(w, '^[{quoted}]*') AS run FROM e2),
      e4 AS (SELECT *, length(run) BETWEEN 1 AND 80 AND NOT regexp_matches(run, '\r?\n[ \t]*(?:[-*+•|]|[0-9]+[.)])[ \t]') AND (k = 2 OR g <> '') AS fine FROM e3),
      e5 AS (SELECT doc_id, k, w, fine AND NOT regexp_matches(run, '["“‘''`*|-]') AS clear, sum(n) OVER r - n AS words, sum(CASE WHEN fine OR k = 2 THEN 0 ELSE 1 END) OVER r AS bad, regexp_matches(g, '{gap}') AS joined,
          regexp_matches(w, '{word}') AS good, regexp_matches(w, '{six}') AS long, regexp_replace(w, '[{quoted}]+$', '') AS bare, n FROM e4 WINDOW r AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
      e6 AS (SELECT doc_id, k, clear, words, bad, good AND lead(good, 1) OVER r AND lead(regexp_matches(bare, '{word}'), 2) OVER r AND lead(joined, 1) OVER r AND lead(joined, 2) OVER r AS phrase,
          long OR lead(long, 1) OVER r OR lead(long, 2) OVER r AS long, w || ' ' || lead(w, 1) OVER r || ' ' || lead(bare, 2) OVER r AS said, lead(words + n, 2) OVER r AS words_after, lead(bad, 2) OVER r AS bad_after
        FROM e5 WINDOW r AS (PARTITION BY doc_id ORDER BY k)),
      e7 AS (SELECT a.doc_id, a.k FROM (SELECT *, k + 3 AS least FROM e6 WHERE phrase AND long) a ASOF JOIN (SELECT * FROM e6 WHERE phrase AND clear) b ON a.doc_id = b.doc_id AND a.said = b.said AND a.least <= b.k
        WHERE b.words - a.words_after <= {steps} AND b.bad = a.bad_after),
      e8 AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list(k::BIGINT + 3 ORDER BY k)), lambda a, x: CASE WHEN x >= (a >> 24) + 3 THEN (x << 24) + (a & 16777215) + 1 ELSE a END) & 16777215 AS n FROM e7 GROUP BY doc_id)
      SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notes FROM {table} LEFT JOIN e8 USING (doc_id)"""
