"""Token counts of whole texts for a sentencepiece BPE vocabulary, by the whole-token shortcut.

No piece of the vocabulary has a space mark behind another character, so no merge crosses the place
before a run of space marks, and a text's count is the sum over its pre-tokens. A pre-token that is
itself a piece which is proved to encode alone as one token counts one; the library merges only the
rest, each once as long as the worker remembers it. The proof is made when the vocabulary is read:
every piece is encoded alone.

Null and empty texts count no token. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SPACE = "▁"  # what the library writes for a space
PRE_TOKEN = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MEMO, AT_ONCE = 300_000, 4_000_000


class PieceCounts:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        texts = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("a piece has a space mark behind another character: merges cross pre-tokens")
        starts = [t for t in texts if t.startswith(SPACE)]
        #: Pieces that alone, as a pre-token, are one token.
        self.whole = {t for t, n in zip(starts, self.merged(starts)) if n == 1}
        self.memo: dict[str, int] = {}

    def merged(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of pre-tokens that start with a space mark, by the library, which puts one before each."""
        found = self.model.encode([t[1:] for t in pre_tokens], num_threads=1)
        return [len(x) if t != SPACE else 1 for t, x in zip(pre_tokens, found)]  # to an empty text it adds none

    def counts(self, texts: list[str]) -> Iterator[int]:
        held, chars = [], 0
        for text in texts:
            # The library puts a space before any text but the empty one.
            own = PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []
            held.append(own)
            chars += len(text)
            if chars >= AT_ONCE:
                yield from self.resolved(held)
                held, chars = [], 0
        yield from self.resolved(held)

    def resolved(self, held: list[list[str]]) -> Iterator[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*held).difference(self.memo))
        rest = [t for t in new if t not in self.whole]
        self.memo.update(dict.fromkeys(new, 1))
        for k in range(0, len(rest), 8192):
            self.memo.update(zip(rest[k : k + 8192], self.merged(rest[k : k + 8192])))
        for own in held:
            yield sum(map(self.memo.__getitem__, own))


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counts(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array(list(count.counts(texts)), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
