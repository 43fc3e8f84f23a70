"""Delivery of a stream to a receiver that fails for some, for a while, and for good."""

import http.server
import json
import threading
from collections import Counter

import pytest

from sparkward.streaming import delivery

SCHEMA = "id string, payload string"


@pytest.fixture
def receiver():
    """Takes rows but those whose payload says never, and takes those that say later at the second try."""
    seen, taken, lock = Counter(), Counter(), threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            key, body = self.headers["Idempotency-Key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen[key] += 1
                fine = body["say"] == "now" or (body["say"] == "later" and seen[key] > 1)
                taken[key] += fine
            self.send_response(200 if fine else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen, taken
    server.shutdown()


def test_each_row_is_taken_or_listed(spark, tmp_path, receiver):
    url, seen, taken = receiver
    source, dead, check = (str(tmp_path / x) for x in ("in", "dead", "check"))
    say = {f"e{k}": ("never" if k % 10 == 3 else "later" if k % 10 == 5 and k % 20 != 5 else "now") for k in range(120)}
    for part in range(2):
        rows = [(k, json.dumps({"say": s})) for k, s in list(say.items())[part * 60 : part * 60 + 60]] + [(None, "{}"), ("x", None)]
        spark.createDataFrame(rows, SCHEMA).repartition(60).write.mode("append").json(source)
        q = delivery.delivered(spark.readStream.schema(SCHEMA).json(source), url, dead, check, retries=2, wait=0.01, private=True)
        q.awaitTermination(120)
        assert q.exception() is None
    gone = {r.id: r.error for r in delivery.dead_letters(spark, dead).collect()}
    assert set(gone) | {k for k, n in taken.items() if n} == set(say) and not set(gone) & {k for k, n in taken.items() if n}
    assert {k for k, s in say.items() if s == "never"} <= set(gone) and all("503" in e for e in gone.values())
    assert not {k for k in gone if say[k] == "now"}
    counts = delivery.batches(spark, dead).groupBy().sum("taken", "given_up").first()
    assert tuple(counts) == (120 - len(gone), len(gone))


def test_a_receiver_that_is_down(spark, tmp_path):
    source, dead, check = (str(tmp_path / x) for x in ("in", "dead", "check"))
    spark.createDataFrame([(f"e{k}", "{}") for k in range(20)], SCHEMA).coalesce(1).write.json(source)
    stream = spark.readStream.schema(SCHEMA).json(source)
    with pytest.raises(ValueError, match="public"):
        delivery.delivered(stream, "http://127.0.0.1:9/", dead, check)
    delivery.delivered(stream, "http://127.0.0.1:9/", dead, check, retries=1, wait=0.01, private=True).awaitTermination(120)
    assert {r.id for r in delivery.dead_letters(spark, dead).collect()} == {f"e{k}" for k in range(20)}
