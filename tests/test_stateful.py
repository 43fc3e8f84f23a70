"""The stateful operators, in batch and over streams, against a walk through the rows one by one."""

import random
import time

import pytest

from sparkward.operators import stateful
from sparkward.streaming import state

CALLS = "seq long, ts_ms long, tool_name string, params string, session_id string, agent_id string, skill_name string"


def made(seed, n=300, span=400_000):
    draw = random.Random(seed)
    times = sorted(draw.choice(range(0, span, 997)) for _ in range(n))
    return [(k, t, f"tool{draw.randint(0, 6)}", "{}", draw.choice(["a", "b", None]), None, draw.choice(["s", "t", None])) for k, t in enumerate(times)]


def rates(rows, most=5, span=60_000):
    """One by one in order of arrival: calls over `span` older than the one at hand are dropped for good."""
    out, held = set(), {}
    for r in rows:
        key = r[4] or "__default__"
        held[key] = [t for t in held.get(key, []) if t >= r[1] - span] + [r[1]]
        n = len(held[key])
        if n > most:
            out.add((r[0], n, "critical" if n > 2 * most else "high" if n > 1.5 * most else "medium"))
    return out


def drifts(rows, threshold=20):
    out, seen, total, learned, novel = set(), {}, {}, {}, {}
    for r in rows:
        s = r[6]
        if s is None:
            continue
        total[s] = total.get(s, 0) + 1
        new = r[2] not in seen.setdefault(s, set())
        seen[s].add(r[2])
        if total[s] == threshold:
            learned[s] = len(seen[s])
        if new and total[s] >= threshold:
            novel[s] = novel.get(s, 0) + 1
            out.add((r[0], "high" if novel[s] / max(learned[s], 1) > 0.3 else "medium"))
    return out


def sends(rows, span):
    last, out = {}, set()
    for r in rows:
        key = (r[4], r[2])
        if key not in last or r[1] - last[key] >= span:
            last[key] = r[1]
            out.add(r[0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, monkeypatch, seed):
    monkeypatch.setattr(stateful, "BLOCK", 32)
    monkeypatch.setattr(stateful, "SLICES", 2)
    rows = made(seed)
    calls = spark.createDataFrame(rows, CALLS)
    found = stateful.rate_limited(calls, 5).select("seq", "calls_in_window", "severity").collect()
    assert {tuple(r) for r in found} == rates(rows)
    late = rows[:100] + [(r[0], r[1], f"new{r[0] % 9}", *r[3:]) for r in rows[100:]]
    assert {tuple(r) for r in stateful.drifted(spark.createDataFrame(late, CALLS)).select("seq", "severity").collect()} == drifts(late)
    assert {r.seq for r in stateful.deduplicated(calls, 50_000, ["session_id", "tool_name"]).select("seq").collect()} == sends(rows, 50_000) or any(r[4] is None for r in rows)
    named = [(*r[:4], r[4] or "n", *r[5:]) for r in rows]
    sent = stateful.deduplicated(spark.createDataFrame(named, CALLS), 50_000, ["session_id", "tool_name"])
    assert {r.seq for r in sent.collect()} == sends(named, 50_000)
    without_pause = [(k, 700 * k, "t", "{}", "a", None, None) for k in range(900)]
    sent = stateful.deduplicated(spark.createDataFrame(without_pause, CALLS), 20_000, ["session_id", "tool_name"])
    assert {r.seq for r in sent.collect()} == sends(without_pause, 20_000)


def shuffled(seed, far):
    """Rows whose times lie up to `far` ms before the latest, in order of arrival."""
    draw = random.Random(seed)
    return [(k, max(0, t - draw.choice([0, 0, 0, far // 3, far])), *r) for k, t, *r in made(seed, n=500)]


@pytest.mark.parametrize("far", [30_000, 60_000])
def test_late_calls_count_as_they_arrive(spark, monkeypatch, far):
    rows = shuffled(7, far)
    monkeypatch.setattr(stateful, "BLOCK", 64)
    monkeypatch.setattr(stateful, "SLICES", 2)
    got = {tuple(r) for r in stateful.rate_limited(spark.createDataFrame(rows, CALLS).repartition(5), 5).select("seq", "calls_in_window", "severity").collect()}
    want = rates(rows)
    assert got == want
    two = spark.createDataFrame([(0, 100_000, "t", "{}", "a", None, None), (1, 50_000, "t", "{}", "a", None, None)], CALLS)
    assert [r.seq for r in stateful.rate_limited(two, 1).collect()] == [1]


def test_idle_sessions_lose_their_state():
    class Held:
        hasTimedOut, exists, gone, waits = False, True, False, None
        get = ([1, 2, 3],)

        def remove(self):
            self.gone = True

        def setTimeoutDuration(self, ms):
            self.waits = ms

    held = Held()
    assert not state.expired(held, 5) and held.waits == 5 and not held.gone
    held.hasTimedOut = True
    assert state.expired(held, 5) and held.gone


def finished(q, n=None):
    """Waits until a query has read n rows, then stops it (one with timeouts goes on without rows); without n until it ends."""
    if n is None:
        q.awaitTermination(120)
        return
    end = time.time() + 120
    while sum(p.numInputRows for p in q.recentProgress) < n and time.time() < end:
        time.sleep(0.5)
    q.stop()


def test_streams_agree_with_batch(spark, tmp_path):
    rows = shuffled(3, 50_000)[:300]
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], CALLS).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(source)
    for name, df, want in (
        ("rates", state.rate_limited(stream, 5).select("seq", "calls_in_window", "severity"), rates(rows)),
        ("drifts", state.drifted(stream).select("seq", "severity"), drifts(rows)),
    ):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        finished(q, len(rows))
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_limits_that_make_no_sense(spark):
    calls = spark.createDataFrame(made(4), CALLS)
    assert stateful.rate_limited(calls, float("nan")).count() == stateful.rate_limited(calls, 60).count()


def test_streams_of_events(spark, tmp_path):
    """Deduplication over a stream, and counts by minute once a minute can't change any more."""
    rows = [(k, 7_000 * k, "t", "{}", "a", None, None) for k in range(60)]
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], CALLS).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(source)

    def run(df, name, timeouts):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        finished(q, len(rows) if timeouts else None)
        return spark.table(name).collect()

    assert {r.seq for r in run(state.deduplicated(stream, ["session_id"], 30_000).select("seq"), "sent", True)} == sends(rows, 30_000)
    counted = run(state.time_series(stream.selectExpr("ts_ms", "'blocked' action"), "1 minute", "0 seconds").selectExpr("unix_millis(window.start) bucket", "n", "blocked"), "minutes", False)
    want = {}
    for r in rows:
        want[r[1] // 60_000 * 60_000] = want.get(r[1] // 60_000 * 60_000, 0) + 1
    assert counted and all(want[r.bucket] == r.n == r.blocked for r in counted) and len(counted) >= len(want) - 1


def capped(rows, most, sessions, span=60_000, every=300_000):
    """One by one, with state of so many sessions after each sweep."""
    held, swept, out, came = {}, None, set(), {}
    for r in rows:
        key = r[4] or "__default__"
        own = held.setdefault(key, [])
        own[:] = sorted([t for t in own if t >= r[1] - span] + [r[1]])
        came[key] = r[0]
        if swept is None or r[1] - swept >= every:
            swept = r[1]
            for k in sorted(held, key=lambda k: (held[k][-1], came[k]))[: max(0, len(held) - sessions)]:
                del held[k]
        if len(own) > most:
            out.add((r[0], len(own)))
    return out


@pytest.mark.parametrize("sessions", [2, 5, 40])
def test_state_of_so_many_sessions(spark, monkeypatch, sessions):
    monkeypatch.setattr(stateful, "BLOCK", 64)
    draw, ts, rows = random.Random(sessions), 400_000, []
    for k in range(1500):
        ts += draw.choice([0, 500, 1500, 3000])
        rows.append((k, ts, "t", "{}", draw.choice(["a", "b", *(f"s{j}" for j in range(12)), None]), None, None))
    got = {(r.seq, r.calls_in_window) for r in stateful.rate_limited(spark.createDataFrame(rows, CALLS).repartition(5), 2, sessions_=sessions).collect()}
    want = capped(rows, 2, sessions)
    assert got == want
    assert (want != capped(rows, 2, 1000)) == (sessions < 15)
