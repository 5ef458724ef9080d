"""What a text must hold for a pattern to match it: words that a plain search finds much faster than the pattern fails."""

from __future__ import annotations

import re

#: A search for more words than this costs more than the pattern.
MOST = 20


def group_end(p: str, i: int) -> int:
    """Where the group or class that begins at i ends."""
    if p[i] == "[":
        j = i + 1 + (p[i + 1] == "^")
        j += p[j] == "]"
        while p[j] != "]":
            j += 2 if p[j] == "\\" else 1
        return j + 1
    depth, j = 0, i
    while True:
        if p[j] == "\\":
            j += 2
        elif p[j] == "[":
            j = group_end(p, j)
        else:
            depth += (p[j] == "(") - (p[j] == ")")
            j += 1
            if not depth:
                return j


def alternatives(p: str) -> list[str]:
    """The alternatives of p."""
    out, i, at = [], 0, 0
    while i < len(p):
        if p[i] == "|":
            out.append(p[at:i])
            at = i + 1
        i = i + 2 if p[i] == "\\" else group_end(p, i) if p[i] in "([" else i + 1
    return [*out, p[at:]]


def _quantifier(p: str, i: int) -> tuple[str, int]:
    """The quantifier at i, and where it ends."""
    found = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?").match(p, i)
    return (found[0], found.end()) if found else ("", i)


def _optional(quantifier: str) -> bool:
    return quantifier.startswith(("*", "?", "{0"))


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, the one that fewer texts will have a member of: longer words, then fewer."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(min(map(len, s)), 5), -len(s), min(map(len, s)), sorted(s)))


def needed(p: str) -> frozenset[str] | None:
    """Lower-case strings of which every match of p holds one, upper and lower case apart; None where there are no such."""
    if len(parts := alternatives(p)) > 1:
        sets = [needed(x) for x in parts]
        return None if None in sets else frozenset().union(*sets)
    best, run, i = None, "", 0

    def ended() -> None:
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run]))
        run = ""

    while i < len(p):
        c = p[i]
        if c == "(":
            ended()
            end = group_end(p, i)
            inside = re.sub(r"\A\((?:\?(?:<?[=!]|>|[a-z-]*:))?", "", p[i : end - 1])
            looks = re.match(r"\(\?<?[=!]", p[i:end])
            quantifier, i = _quantifier(p, end)
            if not looks and not _optional(quantifier):
                best = _better(best, needed(inside))
            continue
        if c == "[" or c == "\\":
            end = group_end(p, i) if c == "[" else p.index("}", i) + 1 if p[i : i + 3] in (r"\p{", r"\x{") else i + 2
            plain = ""
        else:
            end, plain = i + 1, c.lower() if c.isalnum() or c in " '’-—:," else ""
        quantifier, i = _quantifier(p, end)
        if not plain:
            ended()
        elif not quantifier:
            run += plain
        elif _optional(quantifier):
            ended()
        else:
            run += plain
            ended()
    ended()
    return best


def needed_words(pattern: str) -> tuple[str, ...]:
    """needed(), or nothing where that would be too much to look for."""
    found = needed(pattern)
    return () if found is None or len(found) > MOST else tuple(sorted(found))
