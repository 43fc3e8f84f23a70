"""What the router's steps over streams keep, and what passes through them."""

import random

import pytest

from sparkward.streaming import router


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "seq long, ts_ms long, severity string, rule_name string, tool_name string, size long, good boolean, share double"


def test_state_of_an_escalation_is_a_row_for_each_part_of_the_span(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(k, 7 * k, "low", "r", None, None, None, None) for k in range(3000)]  # all at times of their own
    spark.createDataFrame(rows, SCHEMA).write.json(source)
    stream = router.escalated(spark.readStream.schema(SCHEMA).json(source), span=15_000)
    run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(once=True).start()
    run.awaitTermination()
    assert run.lastProgress["numInputRows"] == 3000
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * router.PARTS


def test_late_events_and_numbers_pass_both_steps(spark, tmp_path):
    """In three batches: counts of a list of times held one by one; what isn't sent again; numbers with nulls and over 2 ** 53 as they were."""
    draw, source, rows = random.Random(4), str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    for k in range(600):
        some = lambda v: v if draw.random() < 0.7 else None
        ts = max(0, k // 200 * 40_000 + draw.randint(-20_000, 40_000))
        rows.append((k, ts, draw.choice(["info", "high", "odd"]), draw.choice(["", None]), draw.choice(["t", None]), some(2**53 + k), some(k % 2 == 0), some(k / 7)))
    stream = router.escalated(spark.readStream.schema(SCHEMA).json(source), 3, 20, 5_000)
    both = router.deduplicated(stream, 2_000, ["rule_name", "tool_name", "severity"])
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], SCHEMA).write.mode("append").json(source)
        all_ = router.caught_up(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        sent = router.caught_up(both, str(tmp_path / "sent"), str(tmp_path / "check-sent"))
    times, want = {}, []
    for r in rows:
        own = times.setdefault(r[3:5], [])
        own[:] = [t for t in own if t > r[1] - 5_000] + [r[1]]
        up = {"info": "low", "high": "critical", "odd": "info"}[r[2]]
        now = "critical" if len(own) >= 20 else up if len(own) >= 3 else r[2]
        want.append((*r[:2], now, *r[3:], len(own), r[2], now != r[2]))
    assert sorted(map(tuple, all_.collect())) == want
    last, passed = {}, []
    for k in range(3):
        for r in sorted(want[200 * k : 200 * k + 200], key=lambda r: (r[1], r[0])):
            key = r[2:5]
            if key not in last or r[1] - last[key] >= 2_000:
                last[key] = r[1]
                passed.append(r)
    assert sorted(map(tuple, sent.collect())) == sorted(passed) and len(passed) > 50
