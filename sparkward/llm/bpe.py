"""BPE encoding and decoding of whole texts by tree concatenation.

Texts up to LEAF characters are encoded as they are. A longer text is cut anywhere into leaves, which
all workers encode in parallel; neighbours are then joined pairwise up a tree. At a join a window of
tokens around it is encoded afresh and grows until its first tokens are the left side's and its last
tokens the right side's. Every adjacent pair of tokens of the joined sequence then stands next to
each other in some correct encoding, which for byte pair merges makes the whole sequence correct.

Null and empty texts have no tokens: zero, the digest of an empty string twice. Leaves carry a key of
their row, so rows that repeat a document id stay apart. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .word_bpe import BEYOND_LATIN, PRE_TOKEN, SPECIAL, Memo, word_bpe, word_memo

LEAF = 16_384
#: Rows of a batch that a worker takes at once: short texts, and leaves or texts to be cut.
SHORT_ROWS, LONG_ROWS = 512, 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
Tokens = np.ndarray  # ids, first characters, characters after the last: a row each
Piece = tuple[int, int, Tokens]  # first character, character after the last, tokens


def clean(text: str, at: int) -> bool:
    """No normalisation reaches across this place, and no contraction starts at it."""
    if at <= 0 or at >= len(text):
        return True
    c = text[at]
    return c != "'" and (c < "\u0300" or (unicodedata.category(c)[0] != "M" and not "\u1100" <= c <= "\u11ff"))


def cut_points(text: str, leaf: int) -> list[int]:
    """Where leaves start: halves of halves, until none is longer than `leaf`.

    A cut moves left out of a special string and to where normalisation doesn't reach across it.
    """
    inside = {k for m in SPECIAL.finditer(text) for k in range(m.start() + 1, m.end())} if "<|" in text else ()

    def halves(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return [a]
        mid = (a + b) // 2
        while mid > a and (mid in inside or not clean(text, mid)):
            mid -= 1
        return [*halves(a, mid), *halves(mid, b)] if a < mid < b else [a]

    return halves(0, len(text))


class Tree:
    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        #: What the ids stand for, and the ids as text.
        self.tokens = [self.bpe.full.id_to_token(i) for i in range(self.bpe.full.get_vocab_size())]
        self.parts = [np.array(x, object) for x in ([str(i) for i in range(len(self.tokens))], self.tokens)]
        self.ends = np.array([bool(t) and t.endswith(self.bpe.suffix) for t in self.tokens])
        #: word -> its tokens: id, first character and character after the last, in 32 bits each.
        self.memo: dict[str, bytes] = Memo()

    def leaf(self, text: str, at: int) -> Tokens:
        """The library's encoding of a piece of text that starts at character `at` of its document."""
        if BEYOND_LATIN.search(text) is None and "<|" not in text and unicodedata.is_normalized("NFC", text) and len(text.lower()) == len(text):
            return self.by_words(text.lower(), at)
        found = self.bpe.full.encode(text, add_special_tokens=False)
        return np.array([(i, a + at, b + at) for i, (a, b) in zip(found.ids, found.offsets)], np.int64).reshape(-1, 3).T

    def by_words(self, text: str, at: int) -> Tokens:
        """As leaf(), for a text that normalisation leaves as it is: pre-tokens are encoded once and then remembered."""
        spans = [(m.start(), m[0]) for m in PRE_TOKEN.finditer(text)]
        new = list(self.memo.missing({w for _, w in spans}))
        for w, x in zip(new, self.bpe.one.encode_batch(new, add_special_tokens=False)):
            self.memo[w] = array("i", chain.from_iterable((i, a, b) for i, (a, b) in zip(x.ids, x.offsets))).tobytes()
        found = [self.memo[w] for _, w in spans]
        starts = np.repeat(np.array([a for a, _ in spans], np.int64), [len(x) // 12 for x in found]) + at
        ids, a, b = np.frombuffer(b"".join(found), np.int32).reshape(-1, 3).T.astype(np.int64)
        return np.stack([ids, a + starts, b + starts])

    def inner(self, text: str, at: int) -> Tokens:
        """As leaf(), for a piece that stops inside a word: its last word gets no end mark."""
        norm, pre = self.bpe.full.normalizer.normalize_str(text), self.bpe.full.pre_tokenizer
        none = np.empty((3, 0), np.int64)
        if len(norm) != len(text) or any(len(self.bpe.full.normalizer.normalize_str(c)) != 1 for c in set(text)) or SPECIAL.search(text):
            return none  # characters moved: offsets would not be the text's; the window grows instead
        words = pre.pre_tokenize_str(norm)
        if not words or words[-1][1][1] != len(text):
            return none
        a = words[-1][1][0]
        found = self.bpe.open.encode(norm[a:], add_special_tokens=False)
        last = np.array([(i, s + at + a, e + at + a) for i, (s, e) in zip(found.ids, found.offsets)], np.int64).reshape(-1, 3).T
        return np.concatenate([self.leaf(text[:a], at), last], axis=1)

    def join(self, text: str, left: Piece, right: Piece) -> Piece:
        """Two neighbouring pieces of `text`, as if they had been encoded in one."""
        (start, _, one), (_, stop, two) = left, right
        (_, a1, b1), (ids2, a2, b2) = one, two
        n, m, width = one.shape[1], two.shape[1], 8
        while True:
            i, j = max(0, n - width), min(m, width)
            while i > 0 and not (b1[i - 1] <= a1[i] and clean(text, int(a1[i]))):
                i -= 1
            # The window's right edge: the end of a word if one is near, else any token's end.
            near = np.flatnonzero(self.ends[ids2[max(j, 1) - 1 : min(m, 4 * width)]])
            far = max(j, 1) + int(near[0]) if len(near) else j
            while far < m and not (far and b2[far - 1] <= a2[far] and clean(text, int(a2[far]))):
                far += 1
            a, b = int(a1[i]) if i else start, int(a2[far]) if far < m else stop
            whole = far == m or self.ends[ids2[far - 1]]
            window = self.leaf(text[a:b], a) if whole else self.inner(text[a:b], a)
            if i == 0 and far == m:
                return start, stop, window
            if window.shape[1] and (i == 0 or (window[:, 0] == one[:, i]).all()) and (far == m or (window[:, -1] == two[:, far - 1]).all()):
                return start, stop, np.concatenate([one[:, :i], window, two[:, far:]], axis=1)
            width *= 4

    def encode(self, text: str, pieces: list[Piece]) -> np.ndarray:
        while len(pieces) > 1:
            pairs = [pieces[k : k + 2] for k in range(0, len(pieces), 2)]
            pieces = [self.join(text, *p) if len(p) == 2 else p[0] for p in pairs]
        return pieces[0][2][0] if pieces else np.empty(0, np.int64)

    def row(self, doc: int, ids: np.ndarray) -> tuple:
        """A document's row of the result: its ids and what they stand for are joined one after the other."""
        return doc, len(ids), *(sha256(" ".join(x[ids].tolist()).encode()).hexdigest() for x in self.parts)


@lru_cache(maxsize=2)
def tree_for(path: str) -> Tree:
    """One for all groups of a worker: it reads the whole vocabulary."""
    return Tree(path)


def packed_tokens(found: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, and by differences where tokens of a leaf stand: the gap before each and its size. Empty where one is out of range."""
    ids, a, b = found
    gaps, sizes = a - np.r_[0, b[:-1]] if len(a) else a, b - a
    if len(ids) and max(np.abs(gaps).max(), sizes.max()) > np.iinfo(np.int16).max:
        ids = gaps = sizes = ids[:0]
    return ids.astype(np.int32), gaps.astype(np.int16), sizes.astype(np.int16)


def unpacked_tokens(ids: np.ndarray, gaps: np.ndarray, sizes: np.ndarray, at: int) -> Tokens:
    sizes = sizes.astype(np.int64)
    b = np.cumsum(gaps.astype(np.int64) + sizes) + at
    return np.stack([ids.astype(np.int64), b - sizes, b])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what a worker makes of a part is bounded."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encoded(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """One row a document: doc_id, n_tokens, digest of its ids, digest of its decoded text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, memo = tree_for(tokenizer), word_memo(tokenizer)
        for part in slices(batches, SHORT_ROWS):
            found = memo.over(part.column(1).to_pylist())
            yield arrow([tree.row(doc, np.frombuffer(b"".join(ids), "<u4")) for doc, ids in zip(part.column(0).to_pylist(), found)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, LONG_ROWS):
            for own, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                starts = cut_points(text, leaf)
                parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(parts)],
                    ["own", "doc_id", "leaf", "start", "text"],
                )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_for(tokenizer)
        for part in slices(batches, LONG_ROWS):
            packed = [packed_tokens(tree.leaf(t, 0)) for t in part.column(4).to_pylist()]
            cols = [pa.array([x[k] for x in packed], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int16(), pa.int16()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, "ids", "gaps", "sizes"])

    def joined(group: pa.Table) -> pa.Table:
        tree, parts = tree_for(tokenizer), group.sort_by("leaf")
        texts, starts = parts["text"].to_pylist(), parts["start"].to_pylist()
        pieces = []
        for at, text, ids, gaps, sizes in zip(starts, texts, parts["ids"], parts["gaps"], parts["sizes"]):
            own = unpacked_tokens(*(x.values.to_numpy() for x in (ids, gaps, sizes)), at) if len(ids) or not text else tree.leaf(text, at)
            pieces.append((at, at + len(text), own))
        ids = tree.encode("".join(texts), pieces)
        return pa.Table.from_batches([arrow([tree.row(parts["doc_id"][0].as_py(), ids)])])

    long_texts = rows.where(F.length("text") > leaf).select(F.monotonically_increasing_id().alias("own"), "doc_id", "text")
    kept = "own long, doc_id long, leaf int, start long, text string"
    cut = saved(long_texts.mapInArrow(leaves, kept).repartition("own", "leaf"), "leaves")  # leaves of one text lie in many files
    trees = cut.mapInArrow(tokens, f"{kept}, ids array<int>, gaps array<smallint>, sizes array<smallint>").groupBy("own").applyInArrow(joined, RESULT)
    return rows.where(F.length("text") <= leaf).mapInArrow(short, RESULT).unionByName(trees)
