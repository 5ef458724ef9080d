"""A check as one call: pattern and judged notes of the same texts, in order, and what the caller should make of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.functions.catalog import BY_ID, CATEGORIES, RULES, select_rules
from tellscan.functions.questions import QUESTIONS, REGISTER, select_questions
from tellscan.operators.backend import Backend, BackendError
from tellscan.operators.judge import USD_PER_TOKEN, judge
from tellscan.operators.scan import NOTE_FIELDS, scan
from tellscan.sources.texts import require_text

#: Nothing found, notes found, a wrong call, a backend that failed.
CLEAN, FOUND, WRONG, FAILED = 0, 1, 2, 3


class UsageError(ValueError):
    """A call that can't mean anything; nothing was read or asked."""


@dataclass(frozen=True)
class Checked:
    """notes: key and a note's fields, with place, kind and ord, by which ordered() sorts. usage is null where nobody was to be asked."""

    notes: DataFrame
    usage: DataFrame | None
    key: str

    def ordered(self) -> DataFrame:
        """The notes by place of their text, line and column; where these are equal patterns come before questions, in catalogue order."""
        return self.notes.orderBy("place", "line", "column", "kind", "ord")

    def status(self) -> int:
        return CLEAN if self.notes.isEmpty() else FOUND


def selected(select: list[str] | None, ignore: list[str] | None, strict: bool, judged: bool) -> tuple[list, list]:
    """(rules, questions) of a selection; a name that no catalogue in use has is a UsageError."""
    named = {*(select or ()), *(ignore or ())}
    patterns = {*BY_ID, *CATEGORIES}
    questions = {x for q in QUESTIONS for x in (q.id, q.category)} if judged else set()
    if unknown := sorted(named - patterns - questions):
        raise UsageError(f"unknown rules or categories: {', '.join(unknown)}")

    def of(known: set[str], names: list[str] | None) -> list[str]:
        return [n for n in names or () if n in known]

    rules = [] if select and not of(patterns, select) else select_rules(of(patterns, select), of(patterns, ignore), strict)
    asked = [] if not judged or (select and not of(questions, select)) else select_questions(of(questions, select), of(questions, ignore), strict)
    return rules, asked


def check(docs: DataFrame, select: list[str] | None = None, ignore: list[str] | None = None, strict: bool = False, markdown: bool = False, backend: Backend | None = None, register: str | None = None, key: str = "path", text_col: str = "text", order: DataFrame | None = None) -> Checked:
    """Pattern notes of docs, and judged ones if there is a backend.

    order (key, place) says where the texts stand, by default in the order of key. register without a backend, an
    unknown name and texts that are all blank are UsageErrors. Without questions the backend is not asked.
    """
    if register is not None and backend is None:
        raise UsageError("a register needs a backend: without one nobody is asked anything")
    rules, questions = selected(select, ignore, strict, backend is not None)
    try:
        require_text(docs, text_col)
    except ValueError as e:
        raise UsageError(str(e)) from e
    found, usage = [], None
    if rules:
        found.append(scan(docs, rules, key, text_col, markdown).withColumn("kind", F.lit(0)))
    if questions:
        notes, usage = judge(docs, backend, questions, key, text_col, markdown, register or REGISTER, strict)
        found.append(notes.withColumn("kind", F.lit(1)))
    notes = found[0] if found else scan(docs.limit(0), list(RULES[:1]), key, text_col).withColumn("kind", F.lit(0))
    for more in found[1:]:
        notes = notes.unionByName(more)
    placed = notes.withColumn("place", F.col(key)) if order is None else notes.join(order.select(key, "place"), key, "left")
    return Checked(placed.select(key, *NOTE_FIELDS, "place", "kind", "ord"), usage, key)


def run_check(docs: DataFrame, **options) -> tuple[int, list, str]:
    """(status, ordered rows, message): a call that is wrong, a text that can't be read or a backend that fails gives no notes at all."""
    status, rows, usage, said = checked(docs, **options)
    return status, rows, said if usage is None else usage_line(usage)


def checked(docs: DataFrame, **options) -> tuple[int, list, dict[str, float] | None, str]:
    """(status, ordered rows, usage by counter or None where nobody was asked, message)."""
    try:
        found = check(docs, **options)
        rows = found.ordered().collect()  # a report, as asked for; use check() for notes that stay distributed
        usage = None if found.usage is None else counters(found.usage)
    except UsageError as e:
        return WRONG, [], None, str(e)
    except (BackendError, PySparkException) as e:
        if "BackendError" in f"{type(e).__name__}: {e}":
            return FAILED, [], None, f"backend failure: {e}"
        if (why := unreadable(e)) is not None:
            return WRONG, [], None, why
        raise
    if usage is not None and not usage.get("requests"):
        return WRONG, [], None, "no paragraph is due for a question: the backend was not asked"
    return FOUND if rows else CLEAN, rows, usage, ""


def unreadable(e: Exception) -> str | None:
    """A line on a file that isn't there or isn't UTF-8; None for another failure."""
    text = str(e)
    if "is not valid UTF-8" in text:
        return next(f"{word} is not valid UTF-8" for line in text.splitlines() if " is not valid UTF-8" in line for word in [line.split(" is not valid UTF-8")[0].split()[-1].strip("'\"")])
    if "PATH_NOT_FOUND" in text or "does not exist" in text or "Permission denied" in text or "FAILED_READ_FILE" in text:
        return text.splitlines()[0]
    return None


def counters(usage: DataFrame) -> dict[str, float]:
    return {r.counter: r.total for r in usage.collect()}  # a row for each counter


def usage_line(usage: DataFrame | dict[str, float]) -> str:
    """What a run asked for, in words: requests first, the other counters by name, and what the tokens cost."""
    totals = dict(usage) if isinstance(usage, dict) else counters(usage)
    requests = int(totals.pop("requests", 0))
    parts = [f"{requests} request{'' if requests == 1 else 's'}", *(f"{int(n)} {k.replace('_', ' ')}" for k, n in sorted(totals.items()))]
    return ", ".join(parts) + f", ${totals.get('input_tokens', 0) * USD_PER_TOKEN:.6f}"


def usage_report(usage: dict[str, float], backend: str) -> dict:
    """The usage of a run as it stands in its JSON."""
    return {"backend": backend, **{k: int(n) for k, n in sorted(usage.items())}, "cost_usd": round(usage.get("input_tokens", 0) * USD_PER_TOKEN, 6)}
