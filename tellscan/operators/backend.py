"""What answers questions: the protocol, the reading of a service's answers, and a backend that needs no service."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

T, R = TypeVar("T"), TypeVar("R")


class BackendError(RuntimeError):
    """The backend gave no usable answer. It fails the job: a half-judged corpus would look clean."""


@dataclass(frozen=True)
class Answer:
    """probabilities: a number (noul), a number for each option (choice) or for each level (score)."""

    type: str
    probabilities: float | dict[str, float] | list[float]
    confidence: float
    usage: dict[str, float] = field(default_factory=dict)


class Backend(Protocol):
    """Is pickled to the executors; ask is called once a request and answers all its questions."""

    name: str

    def ask(self, state: Mapping, questions: Mapping[str, Mapping]) -> dict[str, Answer]: ...


def number(x: object, what: str) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise BackendError(f"{what} is {type(x).__name__}, not a number") from None


def read_answer(question: Mapping, raw: Mapping, usage: Mapping | None = None) -> Answer:
    """An answer from its JSON: levels that were left out are 0, a missing confidence comes from the probabilities.

    A score without any level, an unknown level and anything but numbers is a BackendError.
    """
    kind = question["type"]
    given = raw.get("noul") if kind == "noul" else raw.get("probabilities")
    if kind == "noul":
        p: float | dict[str, float] | list[float] = number(given, "noul")
        sure = abs(p - 0.5) * 2
    else:
        if not isinstance(given, Mapping) or not given:
            raise BackendError(f"{kind} probabilities are {given!r}")
        found = {str(k): number(v, f"probability of {k}") for k, v in given.items()}
        p = found
        if kind == "score":
            places = [str(i) for i in range(len(question["criteria"]))]
            if odd := set(found) - set(places):
                raise BackendError(f"unknown levels {sorted(odd)}")
            p = [found.get(i, 0.0) for i in places]
        best = sorted(found.values(), reverse=True) + [0.0]
        sure = min(1.0, max(0.0, best[0] - best[1]))
    if raw.get("confidence") is not None:
        sure = number(raw["confidence"], "confidence")
    return Answer(kind, p, sure, numbers(usage))


def numbers(usage: object) -> dict[str, float]:
    """The counts in usage; anything else in it is no reason to fail."""
    return {k: float(v) for k, v in usage.items() if isinstance(v, int | float) and not isinstance(v, bool)} if isinstance(usage, Mapping) else {}


def each(backend: Backend, jobs: Iterable[T], do: Callable[[T], R]) -> list[R]:
    """do(job) for every job, in order; as many at once as backend.parallel says (1 if it says nothing). The first failure ends it."""
    workers, jobs = getattr(backend, "parallel", 1), list(jobs)
    if workers < 2 or len(jobs) < 2:
        return [do(j) for j in jobs]
    pool = ThreadPoolExecutor(min(workers, len(jobs)))
    try:
        return list(pool.map(do, jobs))
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """A key is for one host: a redirect is an error, not another host to send it to."""

    def redirect_request(self, *args, **kwargs):
        return None


@dataclass(frozen=True)
class HttpBackend:
    """POSTs {state, model, questions} as JSON and reads {answers, usage}; for a service of the user's own.

    url must be https, or http on this machine. A busy or unreachable service is asked again, tries times in all, with
    a pause of wait seconds that doubles up to a minute; any other refusal fails at once.
    """

    url: str
    model: str
    key: str = field(default="", repr=False)
    timeout: float = 60.0
    tries: int = 6
    wait: float = 5.0
    parallel: int = 8
    name: str = "http"

    def __post_init__(self) -> None:
        at = urllib.parse.urlsplit(self.url)
        if not at.hostname or at.username or not (at.scheme == "https" or (at.scheme == "http" and at.hostname in ("localhost", "127.0.0.1", "::1"))):
            raise ValueError(f"{self.url!r} is no https address")

    def _post(self, body: bytes) -> dict:
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=self.timeout) as got:
            return json.load(got)

    def ask(self, state: Mapping, questions: Mapping[str, Mapping]) -> dict[str, Answer]:
        body = json.dumps({"state": state, "model": self.model, "questions": questions}).encode()
        for n in range(self.tries):
            try:
                reply = self._post(body)
                return {q: read_answer(x, reply["answers"][q], reply.get("usage")) for q, x in questions.items()}
            except (OSError, ValueError, KeyError, TypeError) as e:
                busy = e.code == 429 or e.code >= 500 if isinstance(e, urllib.error.HTTPError) else isinstance(e, OSError)
                if not busy or n + 1 == self.tries:
                    raise BackendError(f"{type(e).__name__}: {e}") from e
                time.sleep(min(60.0, self.wait * 2**n))
        raise BackendError("no try was allowed")


#: A word up to its first digit or capital.
_MARKED = re.compile(r"(?<!\S)[^\s0-9A-Z]*[0-9A-Z]")


@dataclass(frozen=True)
class WordBackend:
    """Judges by counting: the share of words with a digit or a capital decides. Deterministic; for tests and dry runs.

    bias is added to the share, and favour to the probability of A, so that two runs and both orders can differ.
    """

    bias: float = 0.0
    favour: float = 0.0
    name: str = "words"

    #: The paragraph last counted and its length: all sentences of a paragraph are asked about with the same one.
    _last: list = field(default_factory=list, repr=False, compare=False)

    @staticmethod
    def plainness(text: str) -> float:
        words = len(text.split())
        return len(_MARKED.findall(text)) / words if words else 0.0

    def _length(self, value: object) -> int:
        if not isinstance(value, dict):
            return len(str(value))
        if not self._last or self._last[0][0] is not value:
            self._last[:] = [(value, len(str(value)))]
        return self._last[0][1]

    def ask(self, state: Mapping, questions: Mapping[str, Mapping]) -> dict[str, Answer]:
        if "A" in state:
            a, b = self.plainness(state["A"]), self.plainness(state["B"])
            p = min(1.0, max(0.0, 0.5 + (a - b) / 2 + self.favour))
            made: dict[str, Answer] = {"keep": Answer("choice", {"A": p, "B": 1 - p}, abs(2 * p - 1))}
            if "drift" in questions:
                d = float(sorted(state["A"].split()) != sorted(state["B"].split()))
                made["drift"] = Answer("noul", d, 1.0)
            return made
        x = self.plainness(state.get("target") or state.get("paragraph") or "") + self.bias
        usage = {"input_tokens": float(sum(map(self._length, state.values())) // 4)}

        def score(levels: int) -> Answer:
            raw = [abs(1 - abs(min(1.0, 4 * x) - i / (levels - 1))) for i in range(levels)]
            p = [r / sum(raw) for r in raw]
            best = sorted(p, reverse=True)
            return Answer("score", p, min(1.0, 2 * (best[0] - best[1])), usage)

        scores = {k: score(k) for k in {len(q["criteria"]) for q in questions.values()}}
        return {n: scores[len(q["criteria"])] for n, q in questions.items()}
