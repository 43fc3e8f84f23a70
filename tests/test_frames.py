"""Lines of chunks against a walk through them, imports of policies, merged configurations."""

import json
import random

import pytest

from sparkward.operators import configs, policy, stateful
from sparkward.sources import frames


def walked(chunks, most):
    """One stream's chunks in order."""
    buffer, out, nth = "", [], 0

    def kind(line):
        if not line.strip():
            return "blank"
        try:
            json.loads(line)
            return "json"
        except ValueError:
            return "dropped"

    for text in chunks:
        buffer += text
        if len(buffer) > most:
            return out
        *lines, buffer = buffer.split("\n")
        for line in lines:
            line = line.removesuffix("\r")
            out.append((nth, line, kind(line)))
            nth += 1
    if buffer.strip():
        out.append((nth, buffer, kind(buffer)))
    return out


@pytest.mark.parametrize("most", [60, 10_000])
def test_lines_of_chunks_cut_anywhere(spark, monkeypatch, most):
    monkeypatch.setattr(stateful, "BLOCK", 16)
    monkeypatch.setattr(frames, "BLOCK", 16)
    draw, rows, want = random.Random(most), [], set()
    for stream in range(12):
        lines = [draw.choice(['{"id": 1}', "", "  ", "{broken", "[1, 2]", "\t", '{"é": "漢"}', '"' + "x" * draw.randint(0, 50) + '"']) + draw.choice(["", "\r"]) for _ in range(draw.randint(0, 40))]
        text = "\n".join(lines) + draw.choice(["", "\n", '\n{"last": 1}'])
        cuts = sorted(draw.randint(0, len(text)) for _ in range(draw.randint(0, 60)))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(f"s{stream}" if stream else None, k, c or None) for k, c in enumerate(chunks)]
        want |= {(f"s{stream}" if stream else None, *r) for r in walked(chunks, most)}
    draw.shuffle(rows)
    got = frames.lines_of(spark.createDataFrame(rows, "stream string, seq long, text string"), most).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_import_with_reasons(spark):
    given = [
        {"name": "base", "config": {"blockOnCritical": True, "trustedSkills": ["a"]}, "overrides": {"forceBlock": []}},
        {"name": "child", "extends": "base"},
        {"name": "of known", "extends": "known"},
        {"name": "of_known", "extends": "known"},
        {"name": "grandchild", "extends": "lost"},
        {"name": "lost", "extends": "nobody"},
        {"name": "far", "extends": "grandchild"},
        {"name": "loop1", "extends": "loop2"},
        {"name": "loop2", "extends": "loop1"},
        {"name": 7}, {"name": ""}, {"config": {}}, "text", None, [1],
        {"name": "c1", "config": []}, {"name": "c2", "config": None}, {"name": "c3", "config": {"trustedSkills": ["a", 1]}}, {"name": "c4", "config": {"blockOnCritical": "yes"}},
        {"name": "o1", "overrides": {"disabledRules": "x"}}, {"name": "o2", "overrides": {"additionalTrustedSkills": [None]}}, {"name": "o3", "overrides": {}},
    ]
    texts = spark.createDataFrame([("x", json.dumps({"policies": given})), ("bad", "{"), ("none", '{"policies": 1}')], "source string, text string")
    known = spark.createDataFrame([("known",)], "name string")
    got = {(r.source, r.place): (r.name, r.reason) for r in policy.imported(texts, known).collect()}
    fine = {0, 1, 3, 7, 8, 21}
    assert {k for k, v in got.items() if v[1] is None} == {("x", k) for k in fine}
    reason = {k[1]: v[1] for k, v in got.items() if k[0] == "x"}
    assert [reason[k] for k in (4, 5, 6)] == ["parent"] * 3 and {reason[k] for k in (2, 9, 10, 11, 12, 13, 14)} == {"name"}
    assert {reason[k] for k in (15, 16, 17, 18)} == {"config"} and {reason[k] for k in (19, 20)} == {"overrides"}
    assert got["bad", None] == got["none", None] == (None, "format")


def test_configurations(spark):
    layers = [
        ("a", 0, '{"blockOnCritical": false, "trustedSkills": ["x"], "port": 1, "__proto__": {"z": 1}}', True), ("a", 1, '{"blockOnCritical": true, "port": {"n": null}}', True),
        ("b", 0, '{"blockOnCritical": "true", "trustedSkills": {}}', True), ("b", 1, "{broken", True),
        ("c", 0, '{"blockOnCritical": true, "trustedSkills": {"k": 1}}', False), ("d", 0, "[]", True), ("d", 1, None, True),
    ]
    rows = spark.createDataFrame(layers, "installation string, layer int, text string, reachable boolean")
    merged = {(r.installation, r.key): r.value for r in configs.merged(rows).collect()}
    assert merged["a", "blockOnCritical"] == "true" and json.loads(merged["a", "port"]) == {"n": None} and ("a", "__proto__") not in merged
    assert json.loads(merged["a", "trustedSkills"]) == ["x"] and merged["b", "blockOnCritical"] == '"true"' and not any(k[0] == "d" for k in merged)
    audit = {r.installation: (r.status, r.blocks, r.trusted) for r in configs.audited(rows).collect()}
    assert audit == {"a": ("OK", True, 1), "b": ("WARNING", False, 0), "c": ("FAILED", True, 1), "d": ("WARNING", False, 0)}
