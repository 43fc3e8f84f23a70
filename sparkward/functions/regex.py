"""Regular expressions: JavaScript sources in Java's dialect and in RE2's, and an admission check."""

from __future__ import annotations

import re
from re import _parser as parser

_SPACES = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(source: str, flags: str = "") -> str:
    """A JavaScript expression with the same matches in Java: ASCII boundaries, all white space, strict end."""
    out, inside, k = [], False, 0
    while k < len(source):
        c = source[k]
        if c == "\\":
            two = source[k : k + 2]
            k += 2
            if two == "\\s":
                out.append(r"\s" + _SPACES if inside else rf"[\s{_SPACES}]")
            elif two == "\\S" and not inside:
                out.append(rf"[^\s{_SPACES}]")
            elif two == "\\b" and not inside:
                out.append(_BOUNDARY)
            else:
                out.append("/" if two == "\\/" else two)
            continue
        if inside:
            out.append("\\" + c if c in "[&" else c)
            inside = c != "]"
        elif c == "[":
            out.append(c)
            inside = True
            if source[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
        else:
            out.append({"$": r"\z", ".": r"[^\n\r\u2028\u2029]"}.get(c, c))
        k += 1
    return ("(?i)" if "i" in flags else "") + "".join(out)


def open_ended(source: str) -> str:
    """The expression without ends of thousands to its repeats, which stood for what a window of a text can hold."""
    return re.sub(r"\{(\d+),(\d{4,})\}", r"{\1,}", source)


def re2(source: str, flags: str = "") -> str | None:
    """The same for RE2 over ASCII text; None where it has no counterpart."""
    if re.search(r"\(\?[=!<]|\\[1-9]", source):
        return None
    out = open_ended(source.replace("\\/", "/"))
    out = re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", out)
    out = re.sub(r"(?<!\\)\$(?![^\[]*\])", r"\\z", out)
    return ("(?i)" if "i" in flags else "") + out


#: Fixed value: characters of the longest expression that a user may give.
LONGEST = 512
_REPEATS = (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT)


def _literal(branch) -> str | None:
    """The text of a branch that is nothing but plain characters, else None."""
    plain = all(op is parser.LITERAL and (chr(arg).isalnum() or chr(arg) in "_-") for op, arg in branch)
    return "".join(chr(arg) for _, arg in branch) if plain else None


def _ambiguous(items, repeated: bool) -> bool:
    """Whether a part of a parsed expression can match one text in several ways under a repeat, or looks back at a group."""
    for op, arg in items:
        if op in (parser.GROUPREF, parser.GROUPREF_EXISTS):
            return True
        if op in _REPEATS:
            least, most, body = arg
            if repeated and most > 1 and least != most:
                return True
            inner, under = [body], repeated or most > 1
        elif op is parser.BRANCH:
            inner, under = arg[1], repeated
            if repeated:
                texts = sorted(_literal(x) or "" for x in inner)  # the beginning of another stands right before one that it begins
                if any(b.startswith(a) for a, b in zip(texts, texts[1:])):
                    return True
        elif op is parser.SUBPATTERN:
            inner, under = [arg[3]], repeated
        elif op in (parser.ASSERT, parser.ASSERT_NOT):
            inner, under = [arg[1]], repeated
        elif op is parser.ATOMIC_GROUP:
            inner, under = [arg], repeated
        else:
            continue
        if any(_ambiguous(x, under) for x in inner):
            return True
    return False


def _needs(items) -> list[frozenset[str]]:
    out, run = [], ""
    for op, arg in items:
        if op is parser.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is parser.IN and len(arg) <= 4 and all(x is parser.LITERAL for x, _ in arg):
            out.append(frozenset(chr(c).lower() for _, c in arg))
        elif op is parser.BRANCH:
            each = [max(_needs(x), key=lambda s: min(map(len, s)), default=None) for x in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
        elif op is parser.SUBPATTERN:
            out += _needs(arg[3])
        elif op in _REPEATS and arg[0] > 0:
            out += _needs(arg[2])
    return out + ([frozenset([run])] if run else [])


def required(source: str) -> list[list[str]]:
    """Sets of texts of which all that matches an expression holds one each, in lower case; the longest first."""
    try:
        found = _needs(parser.parse(source))
    except re.error:
        return []
    return [sorted(s) for s in sorted(set(found), key=lambda s: (-min(map(len, s)), len(s), sorted(s)))]


def admissible(pattern: str) -> bool:
    """Whether a user's expression is free of what can take exponential time: repeats of what repeats by itself, of
    branches of which one begins another or isn't plain text, and back-references. Judged on the parsed expression."""
    if len(pattern) > LONGEST:
        return False
    try:
        return not _ambiguous(parser.parse(pattern), False)
    except (re.error, RecursionError, OverflowError):
        return False


def compiled(pattern: str) -> str | None:
    """A user's expression for Java, or None if it isn't admissible or isn't one."""
    return java(pattern, "i") if admissible(pattern) else None
