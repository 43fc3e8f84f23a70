"""Self join of documents on the Jaccard similarity of their word n-grams, by prefix trees.

All n-gram sets are ordered alike: grams that a counting sketch over all documents finds frequent come
last, by rising count. Two sets that are similar enough share a gram of their first few, so each set
posts those. Sets that are equal are one class throughout, and what is compared are cells of classes:

1. Each gram's smallest set stands for the gram. A set that its posts allow to link with one such set is
   joined to the one with which it shares most, and what is so joined is one zone; sets that share only
   posts of crowded grams, and too few to link with those that stand for them, are put together by the one
   that they share most with and by size. Zones are cut into cells of about CELL grams, with the zone's smallest set in
   each. Every cell is held against itself. That joins the bulk of any group of near copies.
2. Cells that share posts are held against each other, if the number of posts that they share, how much of
   their sets comes after those, their sizes and their last posts allow a link, and if they aren't one linked component already. In a
   zone of several cells, sets of its largest component are set apart from the rest beforehand.

A cell is a prefix tree of its sets, in an order that all of them have in common, which is walked once for
all sets held against it: what sets of the tree share of a path is counted once, and a set leaves a
subtree when what remains below can't bring its overlap with the smallest set there to the threshold.

Hashes of 64 bits stand for grams; a wrong one would have to fall among the grams of two sets held
against each other, and at their threshold. Null and empty texts have no grams and link with nothing.
Texts of fewer words than a gram are one gram. Rows that repeat or lack an id are documents of their own;
a component's id is the smallest there is in it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, ids_are_keys, marked, saved, with_row_key
from .components import components
from .hashing import in_batches, rolling, word_hashes

GRAM, PERCENT = 5, 80
#: PERCENT of a set's size is whole again after so many more.
PERIOD = 100 // math.gcd(PERCENT, 100)
#: Buckets of the counting sketch, whatever the size of the table; and by how many standard
#: deviations a bucket must exceed the mean for its grams to count as frequent.
SKETCH_BITS, DEVIATIONS = 19, 3
#: Grams of the sets in a cell, about.
CELL = 250_000
#: Sets that post a gram from which on it is crowded; and how far sizes differ in a cell of sets that share such grams.
CROWD, BAND = 16, 1.05
#: Bytes of the table of probes and grams with which a tree is walked at once.
AT_ONCE = 1 << 25


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct n-grams of each text as 64-bit hashes, sorted."""
    hashes, starts = word_hashes([t.lower() for t in texts])  # bytes: A-Z and ASCII white space alone
    full, out = rolling(hashes, GRAM).view(np.int64), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= GRAM:
            out.append(np.unique(full[a : b - GRAM + 1]))
        else:
            short = rolling(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else hashes[:0]  # a short text's gram is no other's
            out.append(short.view(np.int64))
    return out


def bucket(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """How often grams of each bucket occur, where chance doesn't give that; else 0. Counted over all documents."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in in_batches((0, t) for t in batch.column(0).to_pylist()):
                hashes, _ = word_hashes([t.lower() for t in texts])
                counts += np.bincount(bucket(rolling(hashes, GRAM)), minlength=size)  # those across two texts too
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 8192):
            part = at[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    found = rows.toArrow()  # a row a bucket
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    mean = counts.mean()
    return np.where(counts > mean + DEVIATIONS * np.sqrt(mean) + DEVIATIONS, np.minimum(counts, 2**31 - 1), 0).astype(np.int32)


def needed(n: int) -> int:
    """Overlap that a set of n needs at least, whatever it links with."""
    return -(-PERCENT * n // 100)


POSTS = "id long, n int, key1 long, key2 long, light int, level long, last long, post array<long>"


def posts(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """id, n, the set's two keys, its posts, how many of them aren't frequent, and the place of the last in the common order."""
    names = [c.split()[0] for c in POSTS.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_batches(zip(*(c.to_pylist() for c in batch.columns))):
                rows = []
                for doc, found in zip(ids, gram_sets(texts)):
                    n = len(found)
                    if not n:
                        rows.append((doc, 0, 0, 0, 0, 0, 0, found))
                        continue
                    bits = found.view(np.uint64)
                    k1 = int(np.bitwise_xor.reduce(found))
                    k2 = int((bits * (bits >> np.uint64(32) | np.uint64(1))).sum().view(np.int64))
                    level = heavy[bucket(found)]
                    light = n - int(np.count_nonzero(level))
                    at = np.argsort(level, kind="stable")[: n - needed(n) + 1] if light < n else slice(n - needed(n) + 1)
                    post, level = found[at], level[at]
                    rows.append((doc, n, k1, k2, min(light, len(post)), int(level[-1]), int(post[-1]), post))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, POSTS)


def overlaps(sets: list[np.ndarray], sizes: np.ndarray, held: np.ndarray, probes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(set, probes that reach the threshold with it). Walks the prefix tree of `sets`, which are sorted, once.

    sets: grams as numbers, in the common order; sizes: of the sets as they were before grams that no probe
    has were left out; held[g, p]: whether probe p has gram g; probes: their sizes.
    """
    lens = np.array([len(s) for s in sets])
    shared = np.zeros(len(sets), np.int64)  # how long a path each set shares with the one before
    for k in range(1, len(sets)):
        m = min(lens[k - 1], lens[k])
        differ = sets[k - 1][:m] != sets[k][:m]
        shared[k] = differ.argmax() if differ.any() else m
    todo = [(0, len(sets), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    while todo:
        lo, hi, depth, own, got = todo.pop()
        while lo < hi and lens[lo] == depth:
            yield lo, own[(100 + PERCENT) * got >= PERCENT * (probes[own] + sizes[lo])]
            lo += 1
        if lo == hi:
            continue
        starts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] <= depth)).tolist(), hi]
        for a, b in zip(starts, starts[1:]):
            # With all that remains below in common, would even the smallest set do?
            most = np.minimum(probes[own], got + lens[a:b].max() - depth)
            some = (100 + PERCENT) * most >= PERCENT * (probes[own] + sizes[a:b].min())
            if not some.any():
                continue
            end = lens[a] if b == a + 1 else shared[a + 1 : b].min()
            path, left = sets[a][depth:end], own[some]
            more = held[path].sum(0, dtype=np.int64)[left] if 2 * len(left) > len(probes) else held[np.ix_(path, left)].sum(0, dtype=np.int64)
            todo.append((a, b, end, left, got[some] + more))


def tree_links(ids: np.ndarray, grams: np.ndarray, starts: np.ndarray, probe: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between sets in the tree and probes, or of all with all: as many as join what links join.

    Set k has grams[starts[k] : starts[k + 1]].
    """
    sizes = np.diff(starts)
    own = np.repeat(np.arange(len(ids)), sizes)
    values, gram = np.unique(grams, return_inverse=True)
    if probe is None:
        tree_at = probe_at = np.arange(len(ids))
        count = np.bincount(gram, minlength=len(values))
        use = count > 1
    else:
        tree_at, probe_at = np.flatnonzero(~probe), np.flatnonzero(probe)
        count = np.bincount(gram[~probe[own]], minlength=len(values))
        use = (count > 0) & (np.bincount(gram[probe[own]], minlength=len(values)) > 0)
    # The order in common: grams of most sets first, so that beginnings are shared.
    number = np.full(len(values), -1)
    kept = np.flatnonzero(use)
    number[kept[np.argsort(-count[kept], kind="stable")]] = np.arange(len(kept))
    number = number[gram]
    some = number >= 0
    number, own = number[some], own[some]
    order = np.lexsort((number, own))
    number, own = number[order], own[order]
    bounds = np.searchsorted(own, np.arange(len(ids) + 1))
    sets = {k: number[bounds[k] : bounds[k + 1]] for k in tree_at.tolist()}
    tree = np.array(sorted(sets, key=lambda k: sets[k].astype(">u4").tobytes()), np.int64)
    paths, found, up = [sets[k] for k in tree.tolist()], [], list(range(len(ids)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    step = max(1, AT_ONCE // max(1, len(kept)))
    for at in range(0, len(probe_at), step):
        part = probe_at[at : at + step]
        held = np.zeros((len(kept), len(part)), bool)
        for j, k in enumerate(part.tolist()):
            held[number[bounds[k] : bounds[k + 1]], j] = True
        for k, near in overlaps(paths, sizes[tree], held, sizes[part]):
            for x in part[near].tolist():
                a, b = top(int(tree[k])), top(x)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    found.append((int(ids[a]), int(ids[b])))
    return found


def linked_in_cells(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) among the sets of each cell. wanted: id, cell, part, probe (null: all against all)."""
    wanted = saved(wanted, "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in in_batches(enumerate(batch.column("text").to_pylist())):
                rest = [batch.column(name).take(pa.array(at)) for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(gram_sets(texts), pa.list_(pa.int64())), *rest], ["grams", *names])

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        lists = group["grams"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        starts = lists.offsets.to_numpy()
        probe = None if group["probe"].null_count else group["probe"].to_numpy()
        found = tree_links(group["id"].to_numpy(), lists.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0], probe)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    names = wanted.columns
    rows = marked(docs, "id", wanted.select("id"), "some").where("some").select("id", "text").join(wanted, "id")  # texts are smaller than their sets
    rows = rows.mapInArrow(sets, "grams array<long>, " + ", ".join(f"{name} {kind}" for name, kind in wanted.dtypes))
    links = saved(rows.groupBy("cell", "part").applyInArrow(walk, "a long, b long"), "links")
    forget(wanted)
    return links


def shared_posts(classes: DataFrame) -> DataFrame:
    """gram, id, first, many, rest: posts of grams that several classes post; first is the gram's smallest id, rest how many grams of the set come after it."""
    rows = classes.select("id", "n", "light", F.posexplode("post").alias("pos", "gram"))
    rows = rows.select("gram", "id", (F.col("n") - F.col("pos") - 1).alias("rest"), (F.col("pos") >= F.col("light")).alias("frequent"))
    # No gram outside the sketch's frequent ones has more than about 2 ** -SKETCH_BITS of all posts.
    own = W.partitionBy("gram")
    light = rows.where("not frequent").withColumns({"first": F.min("id").over(own), "many": F.count("*").over(own)}).where("many > 1")
    often = rows.where("frequent")
    groups = often.groupBy("gram").agg(F.min("id").alias("first"), F.count("*").alias("many")).where("many > 1")
    names = ("gram", "id", "first", "many", "rest")
    return light.select(*names).unionByName(often.join(groups, "gram").select(*names))


def needs(n: str) -> Column:
    return F.expr(f"({PERCENT} * {n} + 99) div 100")


def near_sizes(a: str, b: str) -> Column:
    return (F.expr(f"{a}high") * 100 >= PERCENT * F.expr(f"{b}low")) & (F.expr(f"{b}high") * 100 >= PERCENT * F.expr(f"{a}low"))


def can_link(same: str, a: str, b: str, ends: bool = True) -> Column:
    """Whether sets of sizes from {a}_low to {a}_high that share at most so many posts can link with those of b.

    All that the set whose last post comes first has in common with the other is posts that they share
    and what it doesn't post. {a}_first and {a}_final: the range of last posts; without ends either may come first.
    """

    def led_by(x: str, y: str) -> Column:
        # What a set of n can bring beyond what it needs rises with n, but for rounding: from one n to that n + PERIOD always.
        tops = [f"greatest({x}_low, {x}_high - {k})" for k in range(PERIOD)]
        most = reduce(or_, [(100 + PERCENT) * (F.expr(same) + needs(n) - 1) >= PERCENT * (F.expr(n) + F.expr(f"{y}_low")) for n in tops])
        return F.expr(f"{x}_first <= {y}_final") & most if ends else most

    return near_sizes(f"{a}_", f"{b}_") & (led_by(a, b) | led_by(b, a))


def first_cells(classes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, end, posted, zone, kind, block: where each set that shares posts belongs, and how many it shares; zone, kind, blocks: the zones of several blocks)."""
    info = classes.select("id", "n", F.struct("level", "last").alias("end"))
    ranges = lambda x: [c.alias(f"{x}_{k}") for k, c in (("low", F.col("n")), ("high", F.col("n")), ("first", F.col("end")), ("final", F.col("end")))]
    same = shared.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("same"), F.max("many").alias("many"))
    same = same.join(info.select("id", *ranges("x")), "id").join(info.select(F.col("id").alias("first"), *ranges("y")), "first")
    able = can_link("same", "x", "y")
    best = F.max(F.struct(able.alias("able"), F.when(able | (F.col("many") >= CROWD), F.col("same")).otherwise(0).alias("same"), (-F.col("first")).alias("first")))
    nearest = saved(same.groupBy("id").agg(best.alias("best")).select("id", "best.able", "best.same", (-F.col("best.first")).alias("first")), "nearest")
    zones = components(nearest.where("able").select(F.col("first").alias("a"), F.col("id").alias("b")))
    weak = nearest.where("not able and same > 0").select("id", F.col("first").alias("center"))
    own = shared.groupBy("id").agg(F.count("*").alias("posted")).join(info, "id").join(zones, "id", "left").join(weak, "id", "left")
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    kind = F.when(F.col("component").isNotNull(), 0).when(F.col("center").isNotNull(), 2 + band).otherwise(1)
    cells = saved(own.select("id", "n", "end", "posted", F.coalesce("component", "center", "id").alias("zone"), kind.alias("kind")), "zones")
    blocks = cells.groupBy("zone", "kind").agg(F.ceil(F.sum("n") / CELL).alias("blocks")).where("blocks > 1")
    blocks = saved(blocks, "large-zones")
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))
    forget(nearest)
    return cells.join(blocks, ["zone", "kind"], "left").select("id", "n", "end", "posted", "zone", "kind", block.alias("block"), (F.col("blocks") > 1).alias("large")), blocks


def linked(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest linked id; its own without links)."""
    docs = docs.select("doc_id", "text")
    fit = ids_are_keys(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), "text") if fit else with_row_key(docs).select(F.col("_key").alias("id"), "text", "doc_id")
    texts = keyed.select("id", "text")
    made = saved(posts(texts, sketch(texts)), "posts")
    one = F.min(F.struct("id", "light", "level", "last", "post")).alias("one")
    classes = saved(made.where("n > 0").groupBy("n", "key1", "key2").agg(one).select("n", "one.*"), "classes")
    shared = saved(shared_posts(classes), "shared-posts")
    cells, large = first_cells(classes, shared)
    cells = saved(cells, "cells")
    # Cells against themselves, each with its zone's smallest set.
    cell = [F.struct("zone", "kind").alias("cell"), F.col("block").cast("int").alias("part"), F.lit(None).cast("boolean").alias("probe")]
    low, high = F.floor(F.col("n") / BAND), F.ceil(F.col("n") * BAND)  # sizes in a cell of sets that share crowded grams
    exact = [F.col("n").alias(x) for x in ("x_low", "x_high")]
    alike = cells.select("*", *exact, low.alias("y_low"), high.alias("y_high"))
    alike = alike.where((F.col("kind") == 0) | ((F.col("kind") > 1) & can_link("posted", "x", "y", ends=False)))
    several = alike.groupBy("zone", "kind").agg(F.count("*").alias("sets")).where("sets > 1")
    members = alike.join(several, ["zone", "kind"]).select("id", *cell)
    roots = large.where("kind = 0").select(F.col("zone").alias("id"), "zone", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")).select("id", *cell)
    links = linked_in_cells(texts, members.unionByName(roots).distinct())
    found = components(links)
    # Cells against each other.
    own = cells.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    part = (F.coalesce("large", F.lit(False)) & (F.col("component") != F.col("zone"))).alias("part")
    homes = cells.groupBy("zone", "kind", "block").agg(F.min("id").alias("home"))
    own = saved(own.select("*", part).join(homes, ["zone", "kind", "block"]).withColumnRenamed("part", "apart"), "members")
    sides = own.groupBy("home", "apart").agg(
        F.min("id").alias("cell"), F.sum("n").alias("grams"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("end").alias("first"), F.max("end").alias("final"),
        F.when(F.min("component") == F.max("component"), F.min("component")).alias("one"),
    )
    sides = saved(sides, "sides")
    own = saved(own.join(sides.select("home", "apart", "cell", "one", "low", "high"), ["home", "apart"]).select("id", "n", "end", "posted", "cell", "home", "one", "low", "high"), "members")
    posted = shared.select("gram", "id", "rest").join(own, "id").groupBy("gram", "cell", "home", "one", "low", "high").agg(F.max("rest").alias("rest"))
    posted = saved(posted, "posted")
    x, y, c = posted.alias("x"), posted.alias("y"), F.col
    apart = (c("x.cell") < c("y.cell")) & (c("x.home") != c("y.home")) & ~F.coalesce(c("x.one") == c("y.one"), F.lit(False)) & near_sizes("x.", "y.")
    pairs = x.join(y, (c("x.gram") == c("y.gram")) & apart).groupBy(c("x.cell").alias("a"), c("y.cell").alias("b")).agg(F.count("*").alias("same"), F.max(F.least("x.rest", "y.rest")).alias("rest"))
    side = lambda k, name: sides.select(c("cell").alias(k), *[c(v).alias(f"{name}_{v}") for v in ("grams", "low", "high", "first", "final")])
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # What two sets have in common is posts that both have and what comes after the last of them in both.
    pairs = pairs.where(can_link("same", "x", "y") & ((100 + PERCENT) * (c("same") + c("rest")) >= PERCENT * (c("x_low") + c("y_low"))))
    more = c("x_grams") >= c("y_grams")  # the tree is that of the larger cell
    pairs = pairs.select(F.when(more, c("a")).otherwise(c("b")).alias("tree"), F.when(more, c("b")).otherwise(c("a")).alias("probe"), "same")
    pairs = saved(pairs, "cell-pairs")

    def able(one: str, other: str) -> DataFrame:
        """tree, id, n: sets of the cells `one` that by themselves may link with some set of `other`."""
        ranges = sides.select(c("cell").alias(other), *[c(v).alias(f"y_{v}") for v in ("low", "high", "first", "final")])
        sets = own.select("id", "n", "posted", c("cell").alias(one), *[c(v).alias(f"x_{k}") for k, v in (("low", "n"), ("high", "n"), ("first", "end"), ("final", "end"))])
        return pairs.join(ranges, other).join(sets, one).where(can_link("least(same, posted)", "x", "y")).select("tree", "id", "n").distinct()

    probes = able("probe", "tree")
    parts = probes.groupBy("tree").agg(F.ceil(F.sum("n") / CELL).alias("parts"))
    to = F.struct(c("tree").alias("zone"), F.lit(-1).alias("kind")).alias("cell")
    trees = able("tree", "probe").join(parts, "tree").select("id", to, F.explode(F.sequence(F.lit(0), c("parts").cast("int") - 1)).alias("part"), F.lit(False).alias("probe"))
    probes = probes.join(parts, "tree").select("id", to, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("probe"))
    across = linked_in_cells(texts, probes.unionByName(trees))
    # Components of components.
    label = found.select(c("id").alias("a"), c("component").alias("ca"))
    ends = across.join(label, "a", "left").join(label.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    wider = components(ends.where("a <> b"))
    named = found.unionByName(wider.select("id", c("id").alias("component")).join(found, "id", "left_anti"))
    top = named.join(wider.select(c("id").alias("component"), c("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    # Back from classes to documents.
    label = classes.select("id", "n").join(top, "id", "left").select(c("id").alias("class"), F.coalesce("component", "id").alias("component"))
    firsts = made.where("n > 0").groupBy("n", "key1", "key2").agg(F.min("id").alias("class")).join(label, "class")
    rows = made.select("id", "n", "key1", "key2").join(firsts.select("n", "key1", "key2", "component"), ["n", "key1", "key2"], "left")
    rows = rows.select("id", c("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    forget(shared, posted, pairs)
    if fit:
        return rows.select(c("id").alias("doc_id"), "n_shingles", c("component").alias("component_id"))
    ids = keyed.select("id", c("doc_id").cast("long").alias("doc_id"))
    return rows.join(ids, "id").join(ids.toDF("component", "component_id"), "component").select("doc_id", "n_shingles", "component_id")
