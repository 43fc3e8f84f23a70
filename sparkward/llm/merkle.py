"""A Merkle manifest of documents: digests of rows, trees of 16 by source and over sources, and proofs.

Every node carries the interval of leaf ranks that it covers in its source, [lo, hi). A level's nodes lie in
buckets as wide as a node of the level above; a node's parent is in its bucket, and contains its interval.
What of the parent's interval is not the node's are two intervals, and the parent's children in them are the
node's siblings to its left and right. So ancestors and proofs are attached level by level, from the root
down, to nodes that stand for 16 times as few rows each level up; a row gets its proof from the one node above it.

Ranks come from a sort over all rows and counts by partition, so that a source with most rows is many tasks.
Where a source has one row, that row's digest is its subroot.

Nulls count as `-`, in source too, where null comes before all others. Rows without an id precede the others
of their source; rows of the same id lie by digest, and equal rows in any order, as it makes no difference.
Empty texts are texts of no bytes; long ones are digested whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of unsigned crc32 of the decimal id; rows where it divides that are tampered with in the manifest's check.
TAMPERED = 5
#: What identifies the one tree over all sources.
TOP = "top"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of each field's bytes, preceded by their count; `-` for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def ranked(leaves: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds `lo`, each row's place in its group, and `n`, the rows of the group."""
    rows = saved(leaves.orderBy(F.col(group).asc_nulls_first(), *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # By partition and group: how many rows of the group come before, and where in the partition it starts.
    counts = rows.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    own = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_group", (before - F.col("_first")).alias("_start"), F.sum("_n").over(own).alias("n"))
    found = rows.withColumn("_own", part).join(starts, (F.col("_own") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.select(*leaves.columns, (place + F.col("_start")).alias("lo"), "n")


def families(nodes: DataFrame, width: int, more: list[str]) -> DataFrame:
    """The nodes one level up, each with its children: tree, n, lo, hi, digest, children (lo, hi, digest, ...)."""
    children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *more)))  # FAN at most
    up = nodes.groupBy("tree", "n", F.expr(f"lo div {width}").alias("bucket")).agg(children.alias("children"))
    lo, hi = F.col("children")[0]["lo"], F.element_at("children", -1)["hi"]
    return up.select("tree", "n", lo.alias("lo"), hi.alias("hi"), joined(F.col("children.digest")).alias("digest"), "children")


def step(children: Column, lo: Column, hi: Column) -> Column:
    """The digests of children in what is left of the parent's interval without [lo, hi): to the left and to the right."""
    side = lambda inside: F.array_join(F.transform(F.filter(children, inside), lambda x: x["digest"]), "")
    return F.struct(side(lambda x: x["hi"] <= lo).alias("left"), side(lambda x: x["lo"] >= hi).alias("right"))


def grown(leaves: DataFrame, more: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels of families from the lowest up, subroots). leaves: tree, n, lo, digest and `more`; tree, n, digest of each root."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels, width = leaves.withColumn("hi", F.col("lo") + 1), [], 1
    roots = nodes.where("n = 1").select("tree", "n", "digest")
    while width < most:
        own = nodes.where(f"n > {width}")  # trees that still have several nodes
        width *= FAN
        levels.append(saved(families(own, width, [] if levels else more), "families"))
        nodes = levels[-1]
        roots = roots.unionByName(nodes.where(f"n <= {width}").select("tree", "n", "digest"))
    return levels, roots


def proven(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest families with `path`, the steps from themselves to the root. tops: tree, path, ... of each tree's root."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    tops, above = tops.withColumnRenamed("tree", "_tree"), None
    for k in reversed(range(len(levels))):
        width = FAN ** (k + 1)
        own = levels[k].alias("c")
        first = own.where(f"n <= {width}").join(tops, F.col("c.tree").eqNullSafe(F.col("_tree"))).select("c.*", "path", *more)
        if above is None:
            above = first
            continue
        # Ancestors by containment, within buckets of the width of the level above.
        bucket = lambda x: F.expr(f"{x}.lo div {width * FAN}")
        parents = above.alias("p")
        inside = F.col("c.tree").eqNullSafe(F.col("p.tree")) & (bucket("c") == bucket("p"))
        inside = inside & (F.col("p.lo") <= F.col("c.lo")) & (F.col("c.hi") <= F.col("p.hi"))
        path = F.concat(F.array(step(F.col("p.children"), F.col("c.lo"), F.col("c.hi"))), F.col("p.path")).alias("path")
        above = first.unionByName(own.where(f"n > {width}").join(parents, inside).select("c.*", path, *[F.col(f"p.{c}") for c in more]))
    return above


PATH = "array<struct<left string, right string>>"


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: which rows are checked with A-Z of their text in lower case; by default those whose id says so.
    """
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in FIELDS[1:]])
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    other = digest(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER))
    leaves = saved(fields.select("doc_id", F.col("source").alias("tree"), digest(*[F.col(c) for c in FIELDS]).alias("digest"), F.when(tampered, other).alias("changed")), "leaves")
    places = saved(ranked(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "ranked")
    levels, roots = grown(places, ["doc_id", "changed"])
    # The tree over sources, whose leaves are the sources' roots.
    roots = saved(roots.withColumnRenamed("tree", "source").select("source", "digest"), "subroots")
    whole = F.lit(TOP).alias("tree")
    upper, top = grown(ranked(roots.withColumn("_all", F.lit(TOP)), "_all", [F.col("source").asc_nulls_first()]).select(whole, "n", "lo", "digest", "source"), ["source"])
    top = top.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    if upper:
        sources = proven(upper, top).withColumn("x", F.explode("children"))
        path = F.concat(F.array(step(F.col("children"), F.col("x.lo"), F.col("x.hi"))), F.col("path"))
        tops = sources.select(F.col("x.source").alias("tree"), path.alias("path"), F.col("x.digest").alias("subroot"), "root")
    else:
        tops = roots.select(F.col("source").alias("tree"), F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = saved(tops, "tops")
    kept = ["doc_id", "leaf", "changed", "subroot", "root", "path"]
    alone = places.where("n = 1").join(tops.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")))
    rows = alone.withColumn("leaf", F.col("digest")).select(*kept)
    if levels:
        own = proven(levels, tops).withColumn("x", F.explode("children"))
        path = F.concat(F.array(step(F.col("children"), F.col("x.lo"), F.col("x.hi"))), F.col("path"))
        rows = rows.unionByName(own.select("x.doc_id", F.col("x.digest").alias("leaf"), "x.changed", "subroot", "root", path.alias("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    # A lone source of one row has a root without any steps; a step of a run of one has no siblings, and is still folded.
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    forget(leaves)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
