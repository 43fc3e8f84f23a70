"""The automaton's masks against a search for each text that an expression needs, and rules that are left out."""

import random

import pytest

from sparkward.functions.candidates import WORD, Candidates
from sparkward.functions.regex import required
from sparkward.operators import detect
from sparkward.plans import engine, samples
from sparkward.plans.patterns import exfil


def marked(c, text):
    return [k for w, m in enumerate(c.masks(text)) for k in range(w * WORD, w * WORD + WORD) if m >> k % WORD & 1]


@pytest.mark.parametrize("family", list(detect.FAMILIES))
def test_masks(family):
    patterns = detect.FAMILIES[family].patterns
    sources = tuple(p[5] for p in patterns) + (exfil.DESTINATIONS if family == "exfil" else ())
    c, draw = Candidates(sources), random.Random(family)
    texts = [t for p in patterns if (t := samples.matching(p[5], p[6]))]
    texts += [" ".join(draw.sample(texts, 3)).upper() for _ in range(60)] + ["", "plain words", "ÜNİCODE ſ K"]
    for t in texts:
        low = t.lower()
        assert marked(c, t) == [k for k, s in enumerate(sources) if all(any(x in low for x in some) for some in required(s))]
    for k, p in enumerate(patterns):
        if t := samples.matching(p[5], p[6]):
            assert k in marked(c, t)


def test_no_expressions():
    assert Candidates(()).masks("text") == []
    assert marked(Candidates(("[0-9]{3}", "abc")), "no") == [0]


CALLS = "seq long, ts_ms long, tool_name string, params string, session_id string, agent_id string, skill_name string"


def test_a_rule_that_fails_does_not_stop_the_others(spark):
    calls = spark.createDataFrame([(1, 1, "read_file", '{"path": "/tmp/x"}', "s", None, None)], CALLS)
    good = {"name": "fine", "description": "d", "severity": "high", "category": "path_violation", "tool_name": "read_file"}
    found = engine.events(calls, engine.Config(declared=[{"name": "broken"}, good, "no rule"], enable_rate=False, enable_baseline=False))
    assert [r.rule_name for r in found.collect() if r.rule_name == "fine"] == ["fine"]
    frames, wrong = engine.isolated({"a": lambda: calls.select("nothing"), "b": lambda: calls})
    assert len(frames) == 1 and list(wrong) == ["a"] and "nothing" in wrong["a"]
