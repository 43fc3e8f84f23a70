"""Collocations of two to four words, counted by dynamic itemset counting.

Texts are cut into pieces and words once, and saved as words' hashes in SHARDS shards (a task of the reading
is one shard's). Steps scan one shard each, in a cycle. Words are counted from the first step on. As soon as
both of a phrase's subphrases (all but its last word, all but its first) have the threshold in what was
counted so far, the phrase is active: it is counted from the next step on for one full cycle, so in each
shard once, and is exact then. Steps end once a cycle has passed in which no phrase became active.

Which phrases have the threshold is kept in a table of slots by hash, one for each length, with the step from
which on they count. So a phrase's first step follows from its own words alone, in every task and at every
step alike. Phrases whose subphrases share slots with others' are counted too; that costs work, and changes
nothing. Slots grow with the table's words, up to 2 ** MOST_SLOTS of a length.
Counts of phrases that end their cycle below the threshold are dropped.

Phrases are counted under 64-bit hashes of language and words; their words are read from the texts once it is
known which phrases have the threshold. Null texts are empty, and null is the language `und`. Rows are texts,
whatever they repeat; long texts are read whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved
from .hashing import BASE, LONGEST, TABLE, in_batches, mix

LONGEST_PHRASE, THRESHOLD, SHARDS, TOP, UNKNOWN = 4, 30, 4, 2000, "und"
#: A longer candidate with so many percent of a phrase's occurrences takes its place.
COVERED = 80
FACTOR = 2_000_000
#: Base-2 logarithms of the least and most slots of a length.
LEAST_SLOTS, MOST_SLOTS = 16, 26
#: Keys that a task remembers to have sent the words of.
REMEMBERED = 1 << 20
#: Words scanned at once.
AT_ONCE = 1 << 20
NEVER = 255
#: Of a byte: 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def seed(lang: str | None) -> int:
    return int.from_bytes(blake2b((UNKNOWN if lang is None else lang).encode(), digest_size=8).digest(), "little")


def pieces(texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """The words' hashes, with 0 after each piece; where in them each text starts (one more at the end); for each
    word its place in them and where it starts and stops in the bytes of all texts; those bytes, in lower case.
    """
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    kind = KIND[data]
    gap = kind > 0
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    start, stop = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.empty((3, 0), np.int64), joined
    size, at = stop - start, np.flatnonzero(~gap)
    first = np.cumsum(size) - size
    place = np.minimum(at - np.repeat(start, size), LONGEST - 1)
    hashes = np.add.reduceat(TABLE[place << 8 | data[at]], first) + size.astype(np.uint64)
    for k in np.flatnonzero(size > LONGEST).tolist():
        hashes[k] = int.from_bytes(blake2b(joined[start[k] : stop[k]], digest_size=8).digest(), "little")
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    hashes = np.maximum(mix(hashes + seeds[text]), np.uint64(1))
    piece = np.cumsum(kind == 2)[start]
    to = np.arange(len(start)) + np.cumsum(np.r_[False, piece[1:] != piece[:-1]])
    out = np.zeros(to[-1] + 2, np.uint64)
    out[to] = hashes
    bounds = np.r_[to, len(out)][np.searchsorted(text, np.arange(len(texts) + 1))]
    return out, bounds, np.stack([to, start, stop]), joined


def longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases, each a word longer than those of `keys`."""
    return mix(keys * np.uint64(BASE) + words)


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def active(words: np.ndarray, since: list[np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, keys, first steps) of the phrases in `words` whose subphrases all have a step in `since`. words: with 0 after each piece."""
    place = np.flatnonzero(words)
    keys = words[place]
    yield 1, place, keys, np.zeros(len(keys), np.uint8)
    first = np.zeros(len(keys), np.uint8)
    for k in range(1, LONGEST_PHRASE):
        own = np.maximum(first, since[k - 1][slot(keys, bits)])
        ends = (own[:-1] < NEVER) & (own[1:] < NEVER) & (place[1:] == place[:-1] + 1)
        at = np.flatnonzero(ends)  # phrases of k words of which the next starts a word later
        last = place[at] + k
        keys, first, place = longer(keys[at], words[last]), np.maximum(own[at], own[at + 1]), place[at]
        yield k + 1, place, keys, first


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The words of a column of lists, about AT_ONCE at a time, cut between rows."""
    for batch in batches:
        rows = batch.column(0)
        bounds, values = np.r_[0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))], rows.flatten().to_numpy().view(np.uint64)
        at = 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
            yield values[bounds[at] : bounds[to]]
            at = to


def shards(docs: DataFrame, n: int) -> DataFrame:
    """words (hashes of each text, with 0 after each piece), n_words, lang, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in in_batches(zip(*(c.to_pylist() for c in batch.columns))):
                words, bounds, at, _ = pieces(texts, np.array([seed(x) for x in langs], np.uint64))
                counts = np.diff(np.searchsorted(at[0], bounds))
                rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(counts), pa.array(langs, pa.string())], ["words", "n_words", "lang"])

    rows = docs.select("lang", "text").mapInArrow(run, "words array<long>, n_words long, lang string")
    return saved(rows.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(n))), "shards", by=("shard",))


def counted(shard: DataFrame, since: list[np.ndarray], bits: int, step: int, n: int) -> DataFrame:
    """first, length, key, count: of phrases that this step counts in the shard, by task."""
    held = shard.sparkSession.sparkContext.broadcast(since)  # slots of fixed number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in in_parts(batches):
            for length, _, keys, first in active(words, held.value, bits):
                for own in np.unique(first).tolist():
                    if own <= step < own + n:
                        found, counts = np.unique(keys[first == own], return_counts=True)
                        same = [pa.array(np.full(len(found), x, np.int32)) for x in (own, length)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["first", "length", "key", "count"])

    return shard.select("words").mapInArrow(run, "first int, length int, key long, count long")


def marked_slots(rows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """By length, the slots of the keys in rows (length, key). A bit for each slot comes to the driver."""
    rows = rows.select("length", F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    words = rows.groupBy("length", F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = {}
    for k in range(1, LONGEST_PHRASE + 1):
        own = words.filter(pc.equal(words["length"], k))
        bit = (own["bits"].to_numpy().view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        row, col = np.nonzero(bit)
        out[k] = own["word"].to_numpy()[row] * 64 + col
    return out


def frequent(texts: DataFrame, threshold: int, n: int) -> tuple[DataFrame, list[np.ndarray], int]:
    """(length, key, count of all words and phrases with the threshold; the steps of slots; their base-2 logarithm)."""
    words = texts.agg(F.sum("n_words")).first()[0] or 0
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, int(words / (2 * threshold)).bit_length()))
    since = [np.full(1 << bits, NEVER, np.uint8) for _ in range(LONGEST_PHRASE - 1)]
    state, step, latest = None, 0, 0
    while step <= latest + n - 1:
        rows = counted(texts.where(F.col("shard") == step % n), since, bits, step, n)
        rows = rows if state is None else rows.unionByName(state)
        sums = rows.groupBy("first", "length", "key").agg(F.sum("count").alias("count"))
        after = saved(sums.where((F.col("count") >= threshold) | (F.col("first") + n - 1 > step)), "phrase-counts")
        if state is not None:
            forget(state)
        state, step = after, step + 1
        for k, own in marked_slots(state.where((F.col("count") >= threshold) & (F.col("length") < LONGEST_PHRASE)), bits).items():
            new = own[since[k - 1][own] == NEVER] if k < LONGEST_PHRASE else own
            if len(new):
                since[k - 1][new], latest = step, step
    return state.where(F.col("count") >= threshold).select("length", "key", "count"), since, bits


def strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes from each start to its stop as strings."""
    size = stop - start
    ends = np.cumsum(size)
    bytes_ = data[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(bytes_))


def lists(columns: list[np.ndarray], n: int) -> pa.Array:
    """Rows of as many numbers as there are columns."""
    flat = np.stack(columns, 1).ravel() if columns else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(columns), pa.int32()), pa.array(flat.view(np.int64)))


NAMED = "length int, key long, lang string, phrase string, left array<long>, right array<long>, inner array<long>"


def named(docs: DataFrame, found: DataFrame, since: list[np.ndarray], bits: int) -> DataFrame:
    """The phrases of several words in `found` with their words, and perhaps some more.

    left, right: the keys of both sides of each cut; inner: the keys of all phrases of two words inside, then of three.
    """
    marks = np.full(1 << bits, NEVER, np.uint8)
    marks[marked_slots(found.where(F.col("length") == LONGEST_PHRASE), bits)[LONGEST_PHRASE]] = 0
    held = docs.sparkSession.sparkContext.broadcast([*since, marks])
    names = [c.split()[0] for c in NAMED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.empty(0, np.uint64)  # keys that this task has sent, sorted; some are sent again when they are too many
        for batch in batches:
            for langs, texts in in_batches(zip(*(c.to_pylist() for c in batch.columns))):
                words, bounds, (to, start, stop), joined = pieces(texts, np.array([seed(x) for x in langs], np.uint64))
                data, langs = np.frombuffer(joined, np.uint8), pa.array([UNKNOWN if x is None else x for x in langs], pa.string())
                word = np.full(len(words) + 1, len(to))
                word[to] = np.arange(len(to))
                apart = np.r_[(start[1:] - stop[:-1] != 1) | (data[stop[:-1]] != 0x20), True][: len(to)]  # words with more than a space between them and the next
                keys, sent = {}, []
                for length, place, own, _ in active(words, held.value[:-1], bits):
                    keys[length] = np.zeros(len(words) + LONGEST_PHRASE, np.uint64)
                    keys[length][place] = own
                    if length == 1:
                        continue
                    some = np.flatnonzero(held.value[length - 1][slot(own, bits)] < NEVER)
                    new, where = np.unique(own[some], return_index=True)
                    fresh = ~np.isin(new, done, assume_unique=True)
                    new, p = new[fresh], place[some[where[fresh]]]
                    sent.append(new)
                    w = word[p]
                    wide = np.any([apart[w + i] for i in range(length - 1)], axis=0)
                    for own_, at, w_ in ((new[~wide], p[~wide], w[~wide]), (new[wide], p[wide], w[wide])):
                        if not len(own_):
                            continue
                        if own_.size and apart[w_[0] : w_[0] + length - 1].any():
                            text = pa.array([b" ".join(joined[a:b] for a, b in zip(start[k : k + length].tolist(), stop[k : k + length].tolist())).decode() for k in w_.tolist()], pa.string())
                        else:
                            text = strings(data, start[w_], stop[w_ + length - 1])
                        left, right = [keys[k][at] for k in range(1, length)], [keys[length - k][at + k] for k in range(1, length)]
                        inner = [keys[k][at + i] for k in range(2, length) for i in range(length - k + 1)]
                        rows = pa.array(np.searchsorted(bounds, at, "right") - 1)
                        cols = [pa.array(np.full(len(at), length, np.int32)), pa.array(own_.view(np.int64)), langs.take(rows), text, *[lists(x, len(at)) for x in (left, right, inner)]]
                        yield pa.RecordBatch.from_arrays(cols, names)
                new = np.concatenate(sent) if sent else done[:0]
                done = np.sort(np.concatenate([done if len(done) < REMEMBERED else done[:0], new]))

    one = F.first(F.struct(*names[2:])).alias("one")
    return docs.select("lang", "text").mapInArrow(run, NAMED).groupBy("length", "key").agg(one).select("length", "key", "one.*")


def scored(named_: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with a, l, r, score of their lowest-scoring cut. counts: length, key, count."""
    own = named_.join(counts.withColumnRenamed("count", "a"), ["length", "key"])
    cut = own.select("length", "key", "a", F.posexplode(F.arrays_zip("left", "right")).alias("at", "cut"))
    sides = cut.select(
        F.col("length").alias("of_length"), F.col("key").alias("of"), "a", (F.col("at") + 1).alias("k"),
        F.explode(F.array(F.struct(F.lit(True).alias("is_left"), (F.col("at") + 1).alias("length"), F.col("cut.left").alias("key")), F.struct(F.lit(False).alias("is_left"), (F.col("length") - F.col("at") - 1).alias("length"), F.col("cut.right").alias("key")))).alias("side"),
    ).select("of_length", "of", "a", "k", "side.*")
    sides = sides.join(counts, ["length", "key"])
    value = lambda left: F.max(F.when(F.col("is_left") == left, F.col("count")))
    cuts = sides.groupBy(F.col("of_length").alias("length"), F.col("of").alias("key"), "a", "k").agg(value(True).alias("l"), value(False).alias("r"))
    score = F.expr(f"({FACTOR}BD * a) div (cast(l as decimal(20, 0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return own.join(cuts.groupBy("length", "key").agg(best), ["length", "key"]).select(*own.columns, "best.score", "best.l", "best.r")


def uncovered(found: DataFrame) -> DataFrame:
    """Candidates that no longer one covers."""
    inside = found.where("length > 2").select(F.col("length").alias("of"), "a", F.posexplode("inner").alias("at", "key"))
    inside = inside.select(F.when(F.col("at") < F.col("of") - 1, 2).otherwise(3).alias("length"), "key", "a")
    most = inside.groupBy("length", "key").agg(F.max("a").alias("covers"))
    return found.join(most, ["length", "key"], "left").where(F.expr(f"covers is null or cast(100BD * covers as decimal(30, 0)) < cast({COVERED}BD * a as decimal(30, 0))"))


def phrases(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, n_shards: int = SHARDS) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    texts = shards(docs, n_shards)
    found, since, bits = frequent(texts, threshold, n_shards)
    candidates = saved(scored(named(docs, found, since, bits), found), "candidates")
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = uncovered(candidates).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = texts.groupBy(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")).agg(F.sum("n_words").alias("n"))
    out = saved(rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "phrases")
    forget(texts, candidates)
    return out
