"""Removal of repeated word windows by seed and extend.

Seeds are winnowed anchors: of the hashes of SEED words in each window of WINDOW words the smallest
is picked, so equal windows pick the same anchor at the same place. An anchor is extended both ways
over all windows that pick it, and anchors with the same seed and the same extended passage form one
class, aggregated before the shuffle: the first place of a class stays, and at all later ones every
window repeats. Only classes of which a seed has several can overlap in part; there the windows of
each class's first place, and no others, are compared one by one. The result per document is the
union of maximal repeats, as word ranges.

Windows are judged by two 64-bit hashes of their words' hashes. Null and empty texts have no
words. Rows that repeat or lack a document id are rows of their own: they follow each other in any one
order, rows without an id after all others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, marked, saved, with_row_key
from .hashing import in_batches, mix, rolling, word_hashes

WINDOW, SEED = 20, 8
#: place: the first window that picks the seed, times 16, plus how many windows do (13 at most).
ANCHORS = "seed long, passage long, doc_id long, place long"


def picks(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` seeds the place of the smallest, the last of equals."""
    # Sliding minimum by doubling; the place breaks ties, later ones first.
    n = len(seeds) - span + 1
    best = np.arange(len(seeds))
    width = 1
    while width * 2 <= span:
        a, b = best[:-width], best[width:]
        best = np.where(seeds[b] <= seeds[a], b, a)
        width *= 2
    a, b = best[:n], best[span - width : span - width + n]
    return np.where(seeds[b] <= seeds[a], b, a)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at ASCII white space alone


def anchors_of(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, passage, text, place) of the anchors of several texts, whose words start at `starts`."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if len(hashes) < WINDOW:
        return (np.empty(0, np.uint64),) * 4
    seeds, windows = rolling(hashes, SEED), rolling(hashes, WINDOW)
    own = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])  # windows within one text
    at = picks(seeds, WINDOW - SEED + 1)[own]
    new = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)] if len(own) else np.empty(0, bool)
    first = np.flatnonzero(new)
    start, many = own[first], np.diff(np.r_[first, len(own)])
    # A passage is its first window, its last, and how they lie: between them they have all its words.
    shape = (many.astype(np.uint64) << np.uint64(40)) + (at[first] - start).astype(np.uint64)
    passage = mix(windows[start] * np.uint64(3) + windows[start + many - 1] * np.uint64(0x9E3779B1) + shape)
    return seeds[at[first]], passage, text[start], (start - starts[text[start]]) * 16 + many


def anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_batches(zip(*(c.to_pylist() for c in batch.columns))):
                seed, passage, text, place = anchors_of(*word_hashes(texts))
                if len(seed):
                    doc = np.array(ids, np.int64)[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.view(np.int64)) for c in (seed, passage, doc, place)], ["seed", "passage", "doc_id", "place"]
                    )

    return docs.select("doc_id", "text").mapInArrow(run, ANCHORS)


def ends(place: Column, more: int) -> tuple[Column, Column]:
    start = F.shiftright(place, 4).cast("int")
    return start.alias("start"), (start + place.bitwiseAND(15).cast("int") + more).alias("stop")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, runs: the word ranges [start, stop) of a text that repeat an earlier place, not yet merged."""
    seeds = anchors(docs)
    classes = seeds.groupBy("seed", "passage").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    # With a column of first, too: the two sides of the join then are one exchange.
    some = F.max("first.doc_id").alias("some")
    several = classes.groupBy("seed").agg(F.count("*").alias("classes"), F.sum("n").alias("rows"), some).where("rows > 1 and some is not null").drop("some")
    known = saved(classes.join(several, "seed").select("seed", "passage", "first", "n", "classes"), "anchor-classes")
    # Later places of a class: all their windows repeat. Anchors are made anew, which is cheaper than to keep them.
    later = (
        seeds.join(known.where("n > 1").select("seed", "passage", "first"), ["seed", "passage"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
        .select("doc_id", *ends(F.col("place"), WINDOW - 1))
    )
    # First places of classes that share their seed with another class: window by window.
    shared = known.where("classes > 1").select("first.doc_id", *ends(F.col("first.place"), 0))
    shared = saved(shared.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs")), "shared-anchors")
    by_doc = marked(docs.select("doc_id", "text"), "doc_id", shared.select("doc_id"), "some").where("some").join(shared, "doc_id").select("doc_id", "text", "runs")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, _ = word_hashes([(text or "").encode()])
                one, two = rolling(hashes, WINDOW), rolling(mix(hashes), WINDOW)
                at = np.unique(np.concatenate([np.arange(r["start"], r["stop"]) for r in runs]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(np.full(len(at), doc), pa.int64()), pa.array(at, pa.int32())],
                    ["one", "two", "doc_id", "start"],
                )

    each = by_doc.mapInArrow(windows, "one long, two long, doc_id long, start int")
    each = saved(each, "windows")
    first = each.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    partly = (
        each.join(first, ["one", "two"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
        .select("doc_id", "start", F.expr(f"start + {WINDOW}").alias("stop"))
    )
    runs = later.unionByName(partly).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    found = saved(runs, "repeats")
    forget(known, shared, each)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    docs = with_row_key(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("id"), F.col("_key").alias("doc_id"), "text")
    found = repeats(docs)
    docs = marked(docs, "doc_id", found.select("doc_id"), "some")  # spares the other texts the shuffle
    whole = docs.where(~F.col("some")).withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType))
    rows = docs.where("some").join(found, "doc_id", "left").select("id", "text", "runs").unionByName(whole.select("id", "text", "runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                own = words_of(text)
                keep = own
                if runs:
                    gone = np.zeros(len(own) + 1, np.int32)
                    np.add.at(gone, [r["start"] for r in runs], 1)
                    np.add.at(gone, [r["stop"] for r in runs], -1)
                    keep = [w for w, g in zip(own, np.cumsum(gone)[:-1].tolist()) if not g]
                out.append((doc, len(own), len(own) - len(keep), sha256(b" ".join(keep)).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return rows.select("id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
