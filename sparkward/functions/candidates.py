"""Which expressions a text can match at all, found in one pass by an automaton over the plain texts that they need."""

from __future__ import annotations

from functools import cache

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import required

#: Bits of a word of a mask.
WORD = 62


class Candidates:
    """An automaton over all texts that expressions need. Each of an expression's sets of texts has a bit; it can match where all its sets were met."""

    def __init__(self, sources: tuple[str, ...]) -> None:
        bits: dict[str, int] = {}
        self.need, n = [], 0
        for source in sources:
            own = 0
            for texts in required(source):
                for t in texts:
                    bits[t] = bits.get(t, 0) | 1 << n
                own |= 1 << n
                n += 1
            self.need.append(own)
        self.trie = ahocorasick.Automaton()
        for t, mask in bits.items():
            self.trie.add_word(t, mask)
        if bits:
            self.trie.make_automaton()
        self.words = words(len(sources))
        # Expressions by their rarest set, so that only those are looked at of which something was met.
        self.always = [k for k, own in enumerate(self.need) if not own]
        self.rest = [(k, own) for k, own in enumerate(self.need) if own]

    def masks(self, text: str) -> list[int]:
        """A bit for each expression that may match, in words."""
        met = 0
        if len(self.trie):
            for _, mask in self.trie.iter(text.lower()):
                met |= mask
        out = [0] * self.words
        for k in self.always:
            out[k // WORD] |= 1 << k % WORD
        if met:
            for k, own in self.rest:
                if met & own == own:
                    out[k // WORD] |= 1 << k % WORD
        return out


@cache
def candidates(sources: tuple[str, ...]) -> Candidates:
    """Built once in each worker."""
    return Candidates(sources)


def words(n: int) -> int:
    return -(-n // WORD)


def may_match(x: Column, k: int) -> Column:
    """Whether the mask of a chunk has the bit of expression k."""
    return F.get(x["mask"], F.lit(k // WORD)).bitwiseAND(F.lit(1 << k % WORD)) != 0
