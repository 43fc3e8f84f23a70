"""Harmonic packing of documents into sequences of a fixed capacity.

A document of L tokens is cut by its length alone: whole sequences first, then the largest slot
C // k that the rest still fills, until the rest nearly fills a slot itself. Each slot size is one
class, and a sequence of class k holds exactly k pieces, so any worker can fill the bins of any
class knowing only how many pieces of it lie before its own. The pieces of the last, partly filled
bin of each class (at most k - 1 for each k) are packed together by best fit.

Null and empty texts are documents of the final id alone. Rows that repeat a document id are packed
as documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .word_bpe import word_memo

CAPACITY = 4096
#: A rest under WHOLE tokens, or one that leaves at most 1/SLACK of its slot empty, isn't cut.
WHOLE, SLACK = 64, 32


def reciprocals(capacity: int = CAPACITY) -> list[int]:
    """How many pieces a sequence of each class holds: 1 to 64, then in steps of a sixteenth."""
    out = [1]
    while capacity // out[-1] > 16 and out[-1] < 256:
        out.append(max(out[-1] + 1, out[-1] * 17 // 16 if out[-1] >= 64 else 0))
    return out


def cut(length: int, capacity: int, counts: list[int], slots: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, count of the class) of a document's pieces. slots: capacity // count, falling."""
    out, at = [], 0
    while length - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while rest := length - at:
        above = bisect.bisect_right(slots, -rest) - 1  # the last slot that holds the rest
        room = -slots[above]
        if room - rest <= rest // SLACK or rest < WHOLE or above + 1 >= len(slots):
            out.append((at, rest, counts[above]))
            break
        size = -slots[above + 1]
        out.append((at, size, counts[above + 1]))
        at += size
    return out


PIECES = "task int, k int, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The cut documents: nth numbers the pieces of class k within the task that made them."""
    counts = reciprocals(capacity)
    slots = [-(capacity // k) for k in counts]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), dict.fromkeys(counts, 0)
        memo = word_memo(tokenizer)
        end = struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), memo.over(batch.column(1).to_pylist())):
                ids = memoryview(b"".join(found) + end)
                n = len(ids) // 4
                for start, length, k in cut(n, capacity, counts, slots):
                    rows.append((task, k, seen[k], doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    seen[k] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(zip(*rows))], names
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cuts = saved(pieces(docs, tokenizer, end_id, capacity), "pieces")
    made = cuts.groupBy("k", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("k").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = made.select("k", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = {r.k: r.n for r in made.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row a class
    base, bases = 0, []
    for k in sorted(totals):
        bases.append((k, base, totals[k] // k))
        base += totals[k] // k
    classes = spark.createDataFrame(bases, "k int, base long, full long")
    slots = (
        cuts.join(first, ["k", "task"])
        .join(F.broadcast(classes), "k")  # as many rows as reciprocals() has
        .withColumn("nth", F.col("first") + F.col("nth"))
        .withColumn("bin", F.expr("nth div k"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = slots.where("bin < full").select(
        *columns, (F.col("base") + F.col("bin")).alias("sequence_id"), (F.col("nth") % F.col("k")).alias("slot")
    )
    in_bin = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0))).drop("slot")
    out = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])

    def best_fit(rest):
        room: list[tuple[int, int]] = []  # (tokens left, bin), rising
        fill, where = [], []
        for n in rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True]).length:
            at = bisect.bisect_left(room, (n, -1))
            left, b = room.pop(at) if at < len(room) else (capacity, len(fill))
            if b == len(fill):
                fill.append(0)
            where.append((base + b, fill[b]))
            fill[b] += n
            if left > n:
                bisect.insort(room, (left - n, b))
        rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        rest["sequence_id"], rest["offset"] = zip(*where)
        return rest[[*columns, "sequence_id", "offset"]]

    # At most k - 1 pieces of each class, however large the table.
    rest = slots.where("bin >= full").select(*columns).groupBy().applyInPandas(best_fit, out)
    return filled.unionByName(rest)
