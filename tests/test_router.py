"""The router over streams, and tables that change beside it, against the batch form and plain code."""

import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import routing, stateful, versions
from sparkward.schema import SEVERITIES
from sparkward.streaming import router, sessions

EVENTS = "seq long, id string, ts_ms long, category string, severity string, title string, description string, tool_name string, skill_name string, session_id string, rule_name string, matched_pattern string, action string"
DISMISSALS = "id string, place long, rule_name string, tool_name string, skill_name string, expires_at bigint"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State of few keys, so that there are few stores to open for each batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def some_events(seed, n):
    draw, ts, rows = random.Random(seed), 0, []
    for k in range(n):
        ts += draw.choice([0, 1000, 20_000, 90_000, 400_000] if draw.random() < 0.3 else [0, 500, 1000])
        severity = draw.choice(SEVERITIES)
        action = "blocked" if severity == "critical" else "alert"
        rows.append((k, f"e{k}", ts, "c", severity, f"t{k % 4}", "d", f"tool{draw.randint(0, 2)}", draw.choice(["s1", "s2", None]), draw.choice(["a", "b", None]), draw.choice(["r1", "r2", None]), draw.choice(["p", None]), action))
    return rows


def sequential(rows, dismissed):
    """One event at a time. dismissed(k, event): whether it is, when its batch runs."""
    times, sent, out = {}, {}, []
    for k, r in enumerate(rows):
        e = dict(zip([c.split()[0] for c in EVENTS.split(", ")], r))
        own = times.setdefault((e["rule_name"], e["tool_name"]), [])
        own[:] = [t for t in own if e["ts_ms"] - t < 600_000] + [e["ts_ms"]]
        if len(own) >= 10:
            e["severity"] = "critical"
        elif len(own) >= 3:
            e["severity"] = SEVERITIES[min(SEVERITIES.index(e["severity"]) + 1, 4)]
        if dismissed(k, e) and e["action"] != "blocked" and e["severity"] != "critical":
            continue
        key = tuple(e[c] for c in ("session_id", "rule_name", "tool_name", "matched_pattern", "severity"))
        if key not in sent or e["ts_ms"] - sent[key] >= 300_000:
            sent[key] = e["ts_ms"]
            out.append((e["seq"], len(own), e["severity"], f"[{e['severity'].upper()}] {e['title']}"))
    return out


def test_router_over_a_stream(spark, tmp_path):
    """Batches of one file each, a restart for each, dismissals that change between them: what the sequential model sends."""
    rows, source = some_events(11, 900), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    table = versions.Versions(spark, str(tmp_path / "dismissals"), DISMISSALS)
    no = spark.createDataFrame([], DISMISSALS)
    changes = [None, [("a", 1, "r1", None, None, 0)], [("a", 1, "r1", None, None, 5), ("b", 2, None, "tool1", "s2", None)], []]
    stream = spark.readStream.schema(EVENTS).json(source)
    out = router.routed(stream, table.live(), 1_000).select("seq", "count", "severity", "summary")
    for k, change in enumerate(changes):
        if change is not None:
            assert table.change(f"batch-{k}", lambda _, c=change: spark.createDataFrame(c, DISMISSALS) if c else no)
        spark.createDataFrame(rows[k * 225 : k * 225 + 225], EVENTS).coalesce(1).write.mode("append").json(source)
        got = router.caught_up(out, str(tmp_path / "out"), str(tmp_path / "check"))
    covers = [
        lambda e: False,
        lambda e: e["rule_name"] == "r1",
        lambda e: e["tool_name"] == "tool1" and e["skill_name"] == "s2",
        lambda e: False,
    ]
    want = sequential(rows, lambda k, e: covers[k // 225](e))
    assert sorted(map(tuple, got.collect())) == want
    assert 100 < len(want) < len(rows)


def test_router_agrees_with_batch(spark, tmp_path):
    rows, source = some_events(5, 400), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    given = spark.createDataFrame([("a", 1, "r2", None, None, 0)], DISMISSALS)
    stream = router.routed(spark.readStream.schema(EVENTS).json(source), given, 1_000).select("seq", "severity", "summary")
    for k in range(2):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], EVENTS).write.mode("append").json(source)
        got = router.caught_up(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = routing.routed(spark.createDataFrame(rows, EVENTS), given, 1_000).select("seq", "severity", "summary")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_a_change_counts_once(spark, tmp_path):
    """A writer that fails leaves the table as it was; a batch that comes again changes nothing."""
    table = versions.Versions(spark, str(tmp_path / "t"), "id string, place long, v int")
    frame = lambda rows: spark.createDataFrame(rows, "id string, place long, v int")
    ids = lambda: sorted((r.id, r.v) for r in table.read().collect())
    assert ids() == [] and table.live().count() == 0
    assert table.change("1", lambda rows: versions.put(rows, frame([("a", 1, 1), ("b", 2, 1), ("a", 3, 2)]), "id", "place"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        table.change("2", lambda rows: rows.withColumn("v", F.expr("cast(v div 0 as int)")))
    assert ids() == [("a", 2), ("b", 1)]
    again = lambda rows: versions.put(rows, frame([("c", 4, 1), ("b", 5, 7)]), "id", "place")
    assert table.change("2", again) and not table.change("2", again)
    assert ids() == [("a", 2), ("b", 7), ("c", 1)] == sorted((r.id, r.v) for r in table.live().collect())
    assert [r.version for r in table.log().orderBy("version").collect()] == [1, 2]


@pytest.mark.parametrize("most", [3, 10, 50])
def test_oldest_give_way(spark, most):
    """Upserts in batches against a map that holds so many in the order of their coming."""
    draw, model, place, names = random.Random(most), {}, 0, iter(range(10_000))
    rows = spark.createDataFrame([], "id string, place long, v int")
    for _ in range(4):
        batch = []
        for _ in range(draw.randint(1, 12)):
            place += 1
            old = draw.random() < 0.4 and model
            batch.append((draw.choice(list(model)) if old else f"k{next(names)}", place, draw.randint(0, 99)))
        gone = set()
        for key, _, v in batch:
            if key in gone:
                continue
            if key not in model and len(model) >= most:
                gone.add(first := next(iter(model)))
                del model[first]
            model[key] = v
        batch = [b for b in batch if b[0] not in gone or b[0] in model]
        rows = versions.put(rows, spark.createDataFrame(batch, "id string, place long, v int"), "id", "place", most)
        rows = spark.createDataFrame(rows.collect(), "id string, place long, v int")
        assert {r.id: r.v for r in rows.collect()} == model


def test_room_for_dismissals(spark):
    make = lambda rows: spark.createDataFrame(rows, DISMISSALS)
    old = make([("o1", 1, "r", None, None, 0), ("o2", 2, "r", None, None, 50), ("o3", 3, None, "t", None, None)])
    new = make([("n1", 4, "r", None, None, None), ("n2", 5, "", None, "", 0), ("n3", 6, None, None, "s", 99), ("n4", 7, "x", None, None, 200)])
    out, refused = versions.added(old, new, 100, 5)
    assert {r.id for r in out.collect()} == {"o1", "o3", "n1", "n4"}  # over 5 with all, so that what has expired goes
    assert {r.id for r in refused.collect()} == {"n2"}
    out, refused = versions.added(old, new, 100, 3)
    assert {r.id for r in out.collect()} == {"o1", "o3", "n1"} and {(r.id, r.reason.split()[0]) for r in refused.collect()} == {("n2", "at"), ("n4", "maximum")}
    out, refused = versions.added(old, new, 100, 7)
    assert out.count() == 6 and refused.count() == 1
    assert {r.id for r in versions.swept(old, 100).collect()} == {"o1", "o3"}


def test_watchers_get_one_message_an_event(spark):
    row = versions.fed(spark.createDataFrame([some_events(1, 1)[0]], EVENTS).withColumn("id", F.lit("a\r\nb"))).first()
    assert row.id == "ab" and row.message.startswith('{"id":"a\\r\\nb","timestamp":0,')


def test_sessions_end_by_timers(spark, tmp_path):
    """Each batch by a query of its own: the lives of the batch form, but for those that still last."""
    draw, ts, rows, source = random.Random(8), 0, [], str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for k in range(600):
        ts += draw.choice([100, 1000, 30_000]) if draw.random() < 0.97 else 500_000
        rows.append((k, ts, draw.choice(["a", None] if ts % 3 else ["b", "c", "a"])))
    schema, idle = "seq long, ts_ms long, session_id string", 60_000
    stream = sessions.ended(spark.readStream.schema(schema).json(source), idle, "0 seconds")
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], schema).write.mode("append").json(source)
        got = router.caught_up(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = stateful.sessions(spark.createDataFrame(rows, schema), idle).collect()
    lives = {(r.session_id, r.started_at, r.ended_at, r.tool_call_count) for r in batch}
    ended = [(r.session_id, r.started_at, r.ended_at, r.tool_call_count) for r in got.collect()]
    assert len(set(ended)) == len(ended) and set(ended) <= lives and len(ended) > 20
    assert all(r[2] + idle >= max(t for _, t, _ in rows[:400]) for r in lives - set(ended))
