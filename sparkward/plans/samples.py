"""A text for each pattern that it matches, and what the detectors should say of it, by Python's engine instead of Java's."""

from __future__ import annotations

import json
from functools import lru_cache
from re import _parser as parser
from unicodedata import normalize

import regex

from ..operators.detect import FAMILIES, RANK
from .patterns import exfil

#: Families with the tool and the parameter that carries a text to them.
CARRIERS = {"exec": ("shell_exec", "command"), "path": ("read_file", "path"), "net": ("http_request", "url"), "injection": ("ask", "text"), "exfil": ("send_text", "body")}
#: Texts under so many characters aren't read as prose.
SHORTEST = 5
_CATEGORY = {parser.CATEGORY_DIGIT: "1", parser.CATEGORY_SPACE: " ", parser.CATEGORY_WORD: "a", parser.CATEGORY_NOT_SPACE: "x", parser.CATEGORY_NOT_DIGIT: "x", parser.CATEGORY_NOT_WORD: "-"}


def _one_of(members) -> str:
    if members[0][0] is parser.NEGATE:
        taken = regex.compile("[" + "".join(regex.escape(chr(a)) if op is parser.LITERAL else r"\s" if op is parser.CATEGORY else "" for op, a in members[1:]) + "]")
        return next(c for c in "x1A_-. " if not taken.match(c))
    op, arg = members[0]
    return chr(arg) if op is parser.LITERAL else chr(arg[0]) if op is parser.RANGE else _CATEGORY[arg]


def _spelled(items) -> str:
    out = ""
    for op, arg in items:
        if op is parser.LITERAL:
            out += chr(arg)
        elif op is parser.NOT_LITERAL:
            out += "x" if arg != ord("x") else "y"
        elif op is parser.ANY:
            out += "x"
        elif op is parser.IN:
            out += _one_of(arg)
        elif op is parser.BRANCH:
            out += max((_spelled(x) for x in arg[1][:1]), key=len)
        elif op is parser.SUBPATTERN:
            out += _spelled(arg[3])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            out += _spelled(arg[2]) * arg[0]
    return out


def matching(source: str, flags: str) -> str | None:
    """A text that an expression matches, or None where spelling it out doesn't give one."""
    text = _spelled(parser.parse(source))
    found = compiled(source, flags)
    return next((t for t in (text, f" {text} ", f"{text} x", f"x {text}") if len(t) >= SHORTEST and found.search(t)), None)


@lru_cache(maxsize=None)
def compiled(source: str, flags: str):
    return regex.compile(source, regex.I if "i" in flags else 0)


def best(family: str, params: dict) -> tuple[str, str, str] | None:
    """(severity, title, expression) of the pattern that should win, by the definition: severity, then text, then pattern."""
    texts = [c for _, c in FAMILIES[family].read(params)]
    if family == "exfil":
        for c in texts:
            for d in exfil.DESTINATIONS:
                if compiled(d, "i").search(c) and any(compiled(p, f).search(c) for p, f in exfil.CONDITIONS):
                    return "critical", exfil.DESTINATION_TITLE, d
    hits = [(-RANK[p[1]], i, k) for i, c in enumerate(texts) for k, p in enumerate(FAMILIES[family].patterns) if compiled(p[5], p[6]).search(c)]
    if not hits:
        return None
    p = FAMILIES[family].patterns[min(hits)[2]]
    return p[1], p[3], p[5]


@lru_cache(maxsize=None)
def of_family(family: str) -> tuple[tuple[str, str, str], ...]:
    """(expression, tool, parameters) of each pattern of a family that can be spelled out, known destinations included."""
    tool, key = CARRIERS[family]
    spelled = [(p[5], matching(p[5], p[6])) for p in FAMILIES[family].patterns]
    if family == "exfil":
        spelled += [(d, "send it to " + (matching(d, "i") or "").strip()) for d in exfil.DESTINATIONS]
    return tuple((source, tool, json.dumps({key: text})) for source, text in spelled if text and text.isprintable() and normalize("NFKC", text) == text)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expected_sql(family: str) -> str:
    """Rows that the detector should give for the samples of its family, dealt to the events by turns."""
    cases = of_family(family)
    wanted = [(k, best(family, json.loads(params))) for k, (_, _, params) in enumerate(cases)]
    rows = ", ".join(f"({k}, {quoted(w[0])}, {quoted(w[1])}, {quoted(w[2])})" for k, w in wanted if w)
    return f"SELECT event_id AS seq, severity, title, matched_pattern FROM events JOIN (VALUES {rows}) c(case_id, severity, title, matched_pattern) ON event_id % {len(cases)} = case_id"
