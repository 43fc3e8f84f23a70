"""The tail of growing logs against plain code."""

import json
import os
import random

import pytest

from sparkward.sources import tail, views


def run(spark, folder, out, checkpoint):
    q = tail.tailed(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def got(spark, out):
    return sorted((r.file, r.line) for r in spark.read.schema(tail.SCHEMA).parquet(out).collect())


def put(folder, name, data, mode="ab"):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), mode) as f:
        f.write(data)


def test_growing_truncated_and_rotated_logs_across_restarts(spark, tmp_path):
    """Each run is a query of its own that goes on from the checkpoint."""
    folder, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    want = []
    line = lambda name, k, x: f'{name}: line {k} {x} é漢'

    def add(name, texts, unfinished=b"", mode="ab", first=b""):
        put(folder, name, first + b"".join(t.encode() + b"\n" for t in texts) + unfinished, mode)
        want.extend((name, t) for t in texts)

    os.makedirs(folder)
    run(spark, folder, out, check)
    add("a.jsonl", [line("a", k, "one") for k in range(50)], b"unfinished ")
    add("deep/b.jsonl", [line("b", k, "one") for k in range(9)])
    add("short.jsonl", ["s"])
    put(folder, "other.txt", b"not a log\n")
    put(str(tmp_path), "outside.jsonl", b"outside\n")
    os.symlink(str(tmp_path / "outside.jsonl"), os.path.join(folder, "link.jsonl"))
    run(spark, folder, out, check)
    assert got(spark, out) == sorted(want)
    # Grown, from the middle of a line on; truncated to less; rotated to more, with another beginning; a new one.
    put(folder, "a.jsonl", "tail é\n".encode())
    want.append(("a.jsonl", "unfinished tail é"))
    add("deep/b.jsonl", [line("b", k, "truncated") for k in range(3)], mode="wb")
    add("new.jsonl", ["", "  ", "x" * 100])
    run(spark, folder, out, check)
    assert got(spark, out) == sorted(want)
    add("a.jsonl", [line("rotated", k, "two") for k in range(90)], b"{", mode="wb")
    os.remove(os.path.join(folder, "new.jsonl"))
    run(spark, folder, out, check)
    run(spark, folder, out, check)  # nothing new
    add("new.jsonl", ["came back"])
    run(spark, folder, out, check)
    assert got(spark, out) == sorted(want)
    # A batch that was planned but not committed runs again and reads the same.
    commits = sorted(int(f) for f in os.listdir(os.path.join(check, "commits")) if f.isdigit())
    sink = os.path.join(out, "_spark_metadata")
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(os.path.join(check, "commits", name))
    assert os.path.isdir(sink)
    add("a.jsonl", ["}"], first=b"")
    want[-1] = ("a.jsonl", "{}")
    run(spark, folder, out, check)  # the batch again
    run(spark, folder, out, check)
    assert got(spark, out) == sorted(want)


@pytest.mark.parametrize("piece, longest, block", [(7, 40, 3), (64, 20, 16), (1 << 20, 1 << 20, 5)])
def test_pieces_give_each_line_once(monkeypatch, tmp_path, piece, longest, block):
    for name, value in (("PIECE", piece), ("LONGEST", longest), ("BLOCK", block)):
        monkeypatch.setattr(tail, name, value)
    draw = random.Random(piece)
    for _ in range(30):
        lines = ["y" * draw.choice([0, 0, 1, 5, 19, 20, 39, 40, 90]) for _ in range(draw.randint(0, 20))]
        rest = draw.choice(["", "rest"])
        put(str(tmp_path), "a.jsonl", ("".join(x + "\n" for x in lines) + rest).encode(), "wb")
        folder = tail.Folder(str(tmp_path), ".jsonl")
        plan = tail.pieces({}, folder.offsets())
        rows = [r for p in plan for b in folder.lines(p) for r in b.to_pylist()]
        assert [r["line"] for r in rows] == [x if len(x) < longest else None for x in lines]
        starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
        assert [r["at"] for r in rows] == starts


def test_what_offsets_tell():
    was = {"f": {"at": 100, "marks": "a,b"}}
    read = lambda now: [(p.file, p.start, p.stop) for p in tail.pieces(was, now)]
    assert read(was) == [] and read({}) == []
    assert read({"f": {"at": 300, "marks": "a,b,c"}}) == [("f", 100, 300)]  # grown
    assert read({"f": {"at": 40, "marks": "a"}}) == [("f", 0, 40)]  # truncated
    assert read({"f": {"at": 300, "marks": "a,x,c"}}) == [("f", 0, 300)]  # rotated
    assert read({"f": {"at": 100, "marks": "a,b"}, "g": {"at": 5, "marks": ""}}) == [("g", 0, 5)]


def test_entries_of_logs(spark, tmp_path):
    """Whole entries; malformed, blank and too long lines are skipped."""
    folder = str(tmp_path / "logs")
    entry = {"role": "tool", "toolName": "bash", "toolParams": {"command": "ls"}, "timestamp": 1_700_000_000_000, "sessionId": "s"}
    put(folder, "a.jsonl", (json.dumps(entry) + "\n\nnot json\n[1]\n" + json.dumps({"text": "z" * (11 << 20)}) + "\r\n" + json.dumps({"role": "user", "text": "é"}) + "\r\n{").encode())
    rows = views.transcript(tail.tailed(spark, folder, stream=False)).orderBy("at").collect()
    assert [(r.role, r.toolName, r.timestamp, r.sessionId, r.text) for r in rows] == [("tool", "bash", 1_700_000_000_000, "s", None), ("user", None, None, None, "é")]
    assert json.loads(rows[0].toolParams) == {"command": "ls"}
    assert tail.tailed(spark, str(tmp_path / "nowhere"), stream=False).count() == 0
