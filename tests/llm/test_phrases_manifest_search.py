"""Phrases, manifest, vector search and small n-gram components against plain code."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkward.llm import collocations, hamming_index, merkle, ngram_join

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash long, shard int"
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def some_docs(seed=3, n=400):
    draw, rows = random.Random(seed), []
    words = [w + x for w in ("ab", "Cd", "é", "x漢") for x in ("", "e", "F", "g.h", " i", "\tj")]
    common = ["New York", "to be or not", "a b c d e"]
    for k in range(n):
        text = "".join(draw.choice([*words, *common, *common]) + draw.choice([" ", " ", "  ", "\n", ", ", "\t", ";"]) for _ in range(draw.choice([1, 8, 60])))
        rows.append((k if draw.random() < 0.95 else None, draw.choice(["hot"] * 6 + ["s1", "s2", None, "", "é"]), draw.choice(["en", "en", "de", None, "und"]), draw.choice([None, k]), text, "t", 1, 2))
    rows += [(7, "lone", None, None, None, None, None, None), (8, "two", "en", 0, "", "t", 1, 2), (8, "two", "en", 0, "", "t", 1, 2)]
    rows += [rows[5], rows[5], (900, "long", "en", 1, "Long text. " * 40_000, "t", 1, 2)]
    return rows


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\n-\r]", (r[4] or "").translate(SMALL)):
            own = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(own)
            for k in range(1, 5):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    some = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = {(lang, p[i : i + k]) for (lang, p), a in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    out = defaultdict(list)
    for (lang, p), a in some.items():
        if (lang, p) not in covered:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])}


@pytest.mark.parametrize("parts, shards, least", [(7, 4, 30), (3, 3, 4)])
def test_phrases(spark, parts, shards, least):
    rows = some_docs()
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = {tuple(r) for r in collocations.phrases(df, least, 50, shards).collect()}
    assert got == brute_phrases(rows, least, 50)


def test_phrases_of_nothing(spark):
    assert collocations.phrases(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.phrases(spark.createDataFrame([(1, "s", "en", 1, None, "", 1, 1), (2, "s", None, 1, " .\n", "", 1, 1)], DOCS)).count() == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, left, right = 9_000_000_000_000_000, 9_000_000_000_000_001, 9_000_000_000_000_007
    named = spark.createDataFrame([(2, 1, "en", "p q", [11], [12], [])], "length int, key long, lang string, phrase string, left array<long>, right array<long>, inner array<long>")
    counts = spark.createDataFrame([(1, 11, left), (1, 12, right), (2, 1, a)], "length int, key long, count long")
    row = collocations.scored(named, counts).first()
    assert row.score == 2_000_000 * a // (left + right)


def brute_manifest(rows, tampered):
    hexed = lambda s: sha256(s.encode()).hexdigest()

    def leaf(r, lower=False):
        text = r[4].translate(SMALL) if lower and r[4] is not None else r[4]
        return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))

    def tree(level):
        steps = [[] for _ in level]  # of each leaf: (left, right) by level
        under = [[k] for k in range(len(level))]
        while len(level) > 1:
            ups, owners = [], []
            for at in range(0, len(level), 16):
                run = level[at : at + 16]
                for k in range(len(run)):
                    for x in under[at + k]:
                        steps[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
                ups.append(hexed("".join(run)))
                owners.append([x for u in under[at : at + 16] for x in u])
            level, under = ups, owners
        return (level or [None])[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[0][2] for x in sorted(by[s], key=lambda x: x[0])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for ((_, _, own), r), path in zip(sorted(by[s], key=lambda x: x[0]), trees[s][1]):
            steps = path + top
            h = leaf(r, True) if tampered(r) else own
            for a, b in steps:
                h = hexed(a + h + b)
            out.append((r[0], own, trees[s][0], root, hexed("".join(a + b for a, b in steps)), h, h == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("n, parts", [(400, 7), (3, 2), (0, 1)])
def test_manifest(spark, n, parts):
    rows = some_docs(n=n) if n else [(5, None, None, None, "One row", "", 1, 1)]
    rows = rows[:2] if n == 3 else rows
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = sorted(repr(tuple(r)) for r in merkle.manifest(df).collect())
    assert got == brute_manifest(rows, lambda r: r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_of_a_deep_tree(spark):
    """4,500 rows of one source: four levels, the last run of each short."""
    rows = [(k, "one" if k % 9 else f"s{k % 4}", "en", k, f"Text {k}", "", 1, 1) for k in range(5000)]
    got = sorted(repr(tuple(r)) for r in merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(9)).collect())
    assert got == brute_manifest(rows, lambda r: crc32(str(r[0]).encode()) % 5 == 0)


VECTORS = "vec_id long, embedding array<float>, label int, class long, code string, hash long"


def brute_nearest(rows, k, every):
    rows = [(i, v) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    sizes = Counter(len(v) for _, v in rows)
    d = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if len(v) == d]
    out = {}
    for a, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            near = sorted((math.dist(v, w), j is None, j or 0) for b, (j, w) in enumerate(rows) if b != a)
            out.setdefault(i, []).append([(s, None if null else j) for s, null, j in near[:k]])
    return out


def test_search_of_clusters(spark, monkeypatch):
    """Many cells in parts, copies of one vector as a third of all rows: at least 0.97 of the neighbours, with exact scores, ranks and ties."""
    monkeypatch.setattr(hamming_index, "CELL", 64)
    monkeypatch.setattr(hamming_index, "TOGETHER", 16)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 24))
    vectors = [centres[draw.integers(40)] + 0.3 * draw.normal(size=24) for _ in range(2000)]
    rows = [(k, v.tolist(), 0, 1, "x", 2) for k, v in enumerate(vectors)] + [(k, vectors[0].tolist(), 0, 1, "x", 2) for k in range(2000, 3000)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = defaultdict(list)
    for r in hamming_index.nearest(df, 10, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = brute_nearest(rows, 10, 20)
    assert set(got) == set(want)
    assert all(len(x) == 10 and sorted(x) == x for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in near[0]}) for q, near in want.items())
    assert hits >= 0.97 * sum(len(near[0]) for near in want.values())
    at = {k: np.array(v, np.float32).astype(float) for k, v, *_ in rows}
    assert all(abs(s - math.dist(at[q], at[j])) < 1e-9 for q, own in got.items() for s, j in own)
    assert [j for _, j in got[0]] == list(range(2000, 2010)) and [j for _, j in got[2980]] == [0, *range(2000, 2009)]


def test_search_of_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [1.0, inf], [1.0, 2.0, 3.0], [-0.0, 0.0]]
    good = [[1.0, 0.0], [1.0, -0.0], [0.0, 1.0], [3.0, 4.0], [3.0, 4.0], [-1.0, 0.5]]
    rows = [(100 * k, v, 0, 1, "x", 2) for k, v in enumerate(odd)] + [(1000 + 50 * k, v, 0, 1, "x", 2) for k, v in enumerate(good)]
    rows += [(None, [0.5, 0.5], 0, 1, "x", 2), (1100, [2.0, 2.0], 0, 1, "x", 2)]
    got = defaultdict(list)
    for r in hamming_index.nearest(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 6), r.vec_id))
    want = brute_nearest(rows, 10, 100)
    flat = {q: sorted((round(s, 6), j is None, j or 0) for own in lists for s, j in own) for q, lists in want.items()}
    assert {q: sorted((s, j is None, j or 0) for s, j in own) for q, own in got.items()} == flat
    for few in ([], rows[:8], rows[:3] + [rows[8]]):
        assert hamming_index.nearest(spark.createDataFrame(few, VECTORS)).count() == 0


def test_radius_covers_codes_of_substrings():
    """Pigeonhole: codes within the radius agree with the bound of one substring at least."""
    draw = np.random.default_rng(1)
    for _ in range(2000):
        split = draw.integers(0, 20, hamming_index.WORDS)
        assert (split <= hamming_index.bounds(int(split.sum()) + int(draw.integers(0, 3)))).any()


def small_sets(draw, n):
    """Texts of 5 to 45 shingles that overlap at about the threshold, some with boilerplate."""
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    boiler, rows = [" ".join(word() for _ in range(30)) for _ in range(3)], []
    for _ in range(n):
        size = draw.randint(5, 45)
        base = [word() for _ in range(size + 4)]
        for _ in range(draw.randint(1, 7)):
            cut, kind = draw.randint(0, max(1, size // 4)), draw.random()
            own = base[: len(base) - cut] if kind < 0.35 else base + [word() for _ in range(cut)] if kind < 0.7 else base[cut:] + [word() for _ in range(draw.randint(0, cut) if kind < 0.85 else 0)]
            rows.append(" ".join(own) + (" " + draw.choice(boiler) if draw.random() < 0.15 else ""))
            base = own if draw.random() < 0.5 else base
    # What was lost once: sizes 33 to 40 with an overlap of 32.
    core = [word() for _ in range(36)]
    rows += [" ".join(core + [word() for _ in range(k)]) for k in range(1, 9)]
    draw.shuffle(rows)
    return rows


def components(rows):
    sets, at, up = [], defaultdict(list), list(range(len(rows)))
    for k, t in enumerate(rows):
        own = t.split()
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, own in enumerate(sets):
        shared = Counter(m for g in own for m in at[g])
        for m, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[m]) - n):
                a, b = top(k), top(m)
                up[max(a, b)] = min(a, b)
        for g in own:
            at[g].append(k)
    return {k: top(k) for k in range(len(rows))}


@pytest.mark.parametrize("seed, cell", [(1, None), (2, 300)])
def test_small_components(spark, monkeypatch, seed, cell):
    if cell:
        monkeypatch.setattr(ngram_join, "CELL", cell)
    rows = small_sets(random.Random(seed), 260)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_join.linked(df).collect()} == components(rows)


def test_bound_of_ranges(spark):
    """can_link over ranges of sizes lets through all that it lets through for any sizes in them."""
    draw, rows = random.Random(4), []
    for _ in range(4000):
        low, other = draw.randint(1, 60), draw.randint(1, 60)
        high, far = low + draw.randint(0, 12), other + draw.randint(0, 12)
        same = draw.randint(1, 12)
        one = lambda n, m: 100 * n >= 80 * m and 100 * m >= 80 * n and (180 * (same + -(-80 * n // 100) - 1) >= 80 * (n + m) or 180 * (same + -(-80 * m // 100) - 1) >= 80 * (n + m))
        rows.append((low, high, other, far, same, any(one(n, m) for n in range(low, high + 1) for m in range(other, far + 1))))
    df = spark.createDataFrame(rows, "x_low int, x_high int, y_low int, y_high int, same int, want boolean")
    assert df.where(F.col("want") & ~ngram_join.can_link("same", "x", "y", ends=False)).count() == 0
