"""Redaction of credentials in texts and in nested parameters."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.patterns.redact import MARK, PATTERNS
from .regex import java
from .text import chunks, text_udf

LONG, OVERLAP, DEEP = 16_384, 512, 20


def redacted(text: Column) -> Column:
    """A text column of up to LONG characters with each credential replaced."""
    for source, flags in PATTERNS:
        text = F.regexp_replace(text, java(source, flags), MARK)
    return text


_PY = [re.compile(p.replace("\\/", "/"), re.A | (re.I if "i" in f else 0)) for p, f in PATTERNS]


def redact_string(text: str) -> str:
    if len(text) <= LONG:
        for p in _PY:
            text = p.sub(MARK, text)
        return text
    found = sorted(
        (k * (LONG - OVERLAP) + m.start(), k * (LONG - OVERLAP) + m.end())
        for k, c in enumerate(chunks(text, LONG, LONG, OVERLAP))
        for p in _PY
        for m in p.finditer(c)
    )
    out, at, end = [], 0, -1
    for a, b in found:
        if a > end:
            out += [text[at:a], MARK]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def _walk(v, depth=0):
    if isinstance(v, str):
        return redact_string(v)
    if depth > DEEP or not isinstance(v, (dict, list)):
        return v
    return [_walk(x, depth + 1) for x in v] if isinstance(v, list) else {k: _walk(x, depth + 1) for k, x in v.items()}


def redacted_json(text: str) -> str:
    """Parameters in JSON with credentials in their values replaced; keys stay."""
    try:
        return json.dumps(_walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return '{"_redactionError":"[unable to clone params]"}'


redacted_params = text_udf(redacted_json)
