"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: BITS signs of vectors, centred and rotated. Each WORD of them comes from one rotation, learned on a
bounded sample (the SAMPLE vectors with the smallest hashes) so that rotated vectors lie near corners of the
cube: principal directions first, then by turns the corners and the rotation that brings vectors nearest to them.

Index: a code's substrings, a word each, are its entries. An entry lies in the cell of its substring's first
bits, so many that cells have about CELL entries; cells with more are split into parts.

Search, in two rounds:
1. Each query looks at the cells of its own substrings. Its k-th best distance there bounds that of its true
   neighbours; on the sample was learned how far codes lie apart at a distance, which gives the query's radius.
2. Codes within a radius of r = m * q + a of one in m substrings differ by at most q in one of the first a + 1,
   or by at most q - 1 in one of the others. So each query probes the cells that such substrings can lie in,
   meets in them every code within its radius, each once, and ranks those by the distance of the vectors.
Codes beyond the radius are left to recall: the radius covers SPREAD standard deviations of codes' distances.
A query that finds fewer than k in the first round has all codes within its radius.

Vectors that are equal are one class with its k + 1 smallest ids, so a vector with a third of all rows is one
entry and one query. Both sides of a cell are dealt to tasks by entries and queries, in pieces of bounded size;
a task returns k + 1 rows a query at most. Where vectors have no structure at all (as random ones), a radius
holds a share of all codes, and work grows as queries times entries.

Vectors that are null, zero, or hold a null or a component that isn't finite, take no part, nor do those of
another length than most have (of equally frequent lengths the smaller). Rows that repeat or lack an id are
rows of their own; those without one are never queries and come last among equals. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved, with_row_key

K, EVERY = 10, 100
WORD, WORDS = 64, 4
BITS = WORD * WORDS
SAMPLE, PAIRED = 20_000, 128
#: Standard deviations of the distance of codes that a radius goes beyond their mean.
SPREAD = 2.5
#: Entries of a cell, about, and queries that meet a part of it in one task at most, about.
CELL, TOGETHER = 8192, 4096
#: The longest prefix of a substring that makes a cell, in bits.
LONGEST_PREFIX = 20


class Codes:
    """Rotations and the relation of distances to distances of codes, learned on a sample of vectors."""

    def __init__(self, sample: np.ndarray) -> None:
        draw = np.random.default_rng(7)
        self.mean = sample.mean(0)
        x = sample - self.mean
        d = x.shape[1]
        _, own = np.linalg.eigh(x.T @ x)
        main = own[:, ::-1][:, : min(d, WORD)]  # directions by falling variance
        y = x @ main
        self.turns = []
        for _ in range(WORDS):
            # More bits than directions: those of a wider space that projects on to them.
            turn = np.linalg.qr(draw.normal(size=(WORD, WORD)))[0][: y.shape[1]]
            for _ in range(20):
                corners = np.where(y @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(y.T @ corners, full_matrices=False)
                turn = u @ v
            self.turns.append(main @ turn)
        codes = self.codes(sample)
        pick = draw.permutation(len(sample))[:PAIRED]
        far, apart = [], []
        for k in pick:
            far.append(np.sqrt(((sample - sample[k]) ** 2).sum(1)))
            apart.append(np.bitwise_count(codes ^ codes[k]).sum(1, dtype=np.int64))
        far, apart = np.concatenate(far), np.concatenate(apart)
        some = far > 0
        order = np.argsort(far[some], kind="stable")
        far, apart = far[some][order], apart[some][order] / BITS
        # In groups by distance, the nearest in small ones: mean distance, mean and spread of the share of bits that differ.
        cuts = np.unique(np.r_[np.arange(0, min(len(far), 4000), 200), np.linspace(0, len(far), 65).astype(int)])
        groups = [(far[a:b].mean(), apart[a:b].mean(), apart[a:b].std()) for a, b in zip(cuts, cuts[1:]) if b > a]
        at, share, spread = np.array(groups or [(1.0, 1.0, 0.0)]).T
        self.at, self.share = np.r_[0.0, at], np.maximum.accumulate(np.r_[0.0, share])
        self.spread = np.r_[0.0, np.maximum(spread, np.sqrt(share * (1 - share) / BITS))]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = np.concatenate([(vectors - self.mean) @ t >= 0 for t in self.turns], axis=1)
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)

    def radius(self, distance: np.ndarray) -> np.ndarray:
        """How far codes of vectors at a distance may lie apart; all bits where it is unknown or beyond all seen."""
        mean = np.interp(distance, self.at, self.share, right=1.0)
        found = np.ceil(BITS * (mean + SPREAD * np.interp(distance, self.at, self.spread, right=0.0)))
        return np.where(np.isfinite(distance), np.minimum(found, BITS), BITS).astype(np.int32)


def vectors_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def doubles_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return vectors_of(lists).astype(np.float64)


def fit_rows(rows: DataFrame) -> DataFrame:
    """Rows whose vectors take part: key, vec_id, vector."""
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    whole = with_row_key(rows.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast(kind).alias("vector")))
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = whole.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    size = own.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return own.where(F.size("vector") == (size["size"] if size else 0)).select(F.col("_key").alias("key"), F.col("doc_id").alias("vec_id"), "vector")


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """class (smallest key), ids (struct<id_order, vec_id>, the k + 1 smallest), vector of each distinct vector."""
    hashed = rows.withColumn("hash", F.xxhash64("vector"))
    nth = F.row_number().over(W.partitionBy("hash", "vector").orderBy("key"))
    first = hashed.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("key", "vec_id"))).alias("ids")  # k + 1 at most
    return first.groupBy("hash", "vector").agg(F.min("key").alias("class"), ids)


def cell(code: Column, j: Column, prefix: int) -> Column:
    """The first bits of a code's j-th substring."""
    own = F.get(code, j)
    return F.shiftrightunsigned(own, WORD - prefix) if prefix else F.lit(0).cast("long")


def coded(classes: DataFrame, model: Codes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.codes(doubles_of(batch.column("vector")))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), lists, batch.column("vector")], ["class", "code", "vector"])

    return classes.select("class", "vector").mapInArrow(run, f"class long, code array<long>, vector {classes.schema['vector'].dataType.simpleString()}")


def within(probes: DataFrame, index: DataFrame, prefix: int, search, spec: str) -> DataFrame:
    """What `search` finds of each cell's queries and entries, which both are dealt in pieces. probes: j, cell, query, ...; index: class, code, vector."""
    entries = index.select(F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("j"), "class", "code", "vector")
    entries = entries.withColumn("cell", cell(F.col("code"), F.col("j"), prefix))
    parts = entries.groupBy("j", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("parts"))
    turns = probes.groupBy("j", "cell").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("turns"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = parts.join(turns, ["j", "cell"])
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = probes.join(grid, ["j", "cell"]).withColumn("turn", own("query", "turns")).withColumn("part", spread("parts")).drop("turns", "parts")
    right = entries.join(grid, ["j", "cell"]).withColumn("part", own("class", "parts")).withColumn("turn", spread("turns")).drop("turns", "parts")
    keys = ["j", "cell", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, spec)


FOUND = "query long, class long, score double"


def best_in_cell(most: int, j_only: bool):
    """Of a cell's entries, each query's `most` nearest. Without j_only: of those within the query's radius that no substring before finds."""

    def run(probes: pa.Table, entries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if probes.num_rows and entries.num_rows:
            codes, vectors = vectors_of(entries["code"]).view(np.uint64), vectors_of(entries["vector"])
            ids, queries = entries["class"].to_numpy(), probes["query"].to_numpy()
            own, points, j = vectors_of(probes["code"]).view(np.uint64), doubles_of(probes["vector"]), int(probes["j"][0].as_py())
            radii = probes["radius"].to_numpy()
            for q in range(len(queries)):
                apart = np.bitwise_count(codes ^ own[q])
                total = apart.sum(1, dtype=np.int64)
                if j_only:  # any few do for a bound: those whose codes are nearest
                    some = np.argpartition(total, 4 * most)[: 4 * most] if len(total) > 4 * most else np.arange(len(total))
                else:
                    bound = bounds(int(radii[q]))
                    first = (apart <= bound).argmax(1)  # the substring that finds it; within the radius there is one
                    some = np.flatnonzero((total <= radii[q]) & (first == j))
                near = np.sqrt(((vectors[some] - points[q]) ** 2).sum(1))
                order = np.lexsort((ids[some], near))[:most]
                out[0].append(np.full(len(order), queries[q]))
                out[1].append(ids[some][order])
                out[2].append(near[order])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query": pa.array(cols[0].astype(np.int64)), "class": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    return run


def bounds(radius: int) -> np.ndarray:
    """By substring, how many bits may differ in it, so that codes within the radius are found in one of them."""
    q, a = divmod(radius, WORDS)
    return np.array([q if j <= a else q - 1 for j in range(WORDS)])


def nearest(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id `every` divides, the k nearest other rows that were found."""
    rows = saved(fit_rows(rows), "vectors")
    classes = saved(classes_of(rows, k), "vector-classes")
    sample = classes.orderBy(F.xxhash64("hash"), "class").limit(SAMPLE).select("vector").toArrow()  # bounded: SAMPLE vectors
    out_spec = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return rows.sparkSession.createDataFrame([], out_spec)
    model = Codes(doubles_of(sample["vector"]))
    index = saved(coded(classes, model), "codes")
    prefix = min(LONGEST_PREFIX, max(0, round(np.log2(max(1, classes.count()) / CELL))))
    asked = rows.where(F.col("vec_id") % every == 0).select("key", "vec_id", F.xxhash64("vector").alias("hash"), "vector")
    asked = saved(asked.join(classes.select("hash", "vector", "class"), ["hash", "vector"]).select("key", "vec_id", "class"), "asked")
    queries = saved(index.join(asked.select("class").distinct(), "class", "left_semi").withColumnRenamed("class", "query"), "queries")
    # Round 1: the cells of the query's own substrings.
    every_j = F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("j")
    own = queries.select("query", "code", "vector", F.lit(0).alias("radius"), every_j)
    first = saved(within(own.withColumn("cell", cell(F.col("code"), F.col("j"), prefix)), index, prefix, best_in_cell(k + 1, True), FOUND), "first-round")
    ordered = F.row_number().over(W.partitionBy("query").orderBy("score", "class"))
    kth = first.distinct().withColumn("nth", ordered).where(F.col("nth") == k + 1).select("query", "score")

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.radius(far), pa.int32())], ["query", "radius"])

    radius = saved(queries.select("query").join(kth, "query", "left").mapInArrow(radii, "query long, radius int"), "radii")
    # Round 2: the cells where a substring within its bound can lie.
    q, a = F.expr(f"radius div {WORDS}"), F.col("radius") % WORDS
    most = F.when(F.col("j") <= a, q).otherwise(q - 1)
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << prefix) - 1).cast("long")), lambda x: F.bit_count(x) <= F.col("most"))
    probes = queries.join(radius, "query").select("query", "code", "vector", "radius", every_j).withColumn("most", most.cast("int"))
    probes = probes.withColumn("mask", F.explode(masks)).withColumn("cell", cell(F.col("code"), F.col("j"), prefix).bitwiseXOR(F.col("mask")))
    second = within(probes.drop("most", "mask"), index, prefix, best_in_cell(k + 1, False), FOUND)
    found = saved(second.unionByName(first).distinct().withColumn("nth", ordered).where(F.col("nth") <= k + 1), "found")
    # From classes to rows: of each query's classes the ids, nearest first.
    ids = found.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
    lists = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", F.col("id.key").alias("key"), F.col("id.vec_id").alias("vec_id")))).alias("near"))  # (k + 1) ** 2 at most
    others = F.slice(F.filter("near", lambda x: x["key"] != F.col("key")), 1, k)
    out = asked.join(lists, asked["class"] == lists["query"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
