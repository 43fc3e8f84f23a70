"""Ids of word_bpe_49k.json exactly as the tokenizers library gives them, through a memo of words.

The vocabulary's merges never cross a pre-token and its pre-tokens never cross white space, so a
text's ids are the ids of its words in order. Latin texts are split at white space here; any other
text goes through the library's own normalizer and pre-tokenizer. Merging is always the library's.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

#: Fixed values of the vocabulary file.
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+")
#: Texts with other characters than these are normalised by the library. (1C to 1F: white space
#: to str.split, but not to the vocabulary's pattern.)
BEYOND_LATIN = regex.compile(r"[^\x00-\x1b\x20-ɏ]")
#: Marks before words that are already normalised, and before the ids of special strings.
OWN, SPECIAL_MARK = "\ue000", "\ue001"
#: Words that a memo holds at most, their characters, and characters of text that are resolved at once.
MEMO, MEMO_CHARS, AT_ONCE = 600_000, 6_000_000, 1_000_000
#: Words that the library takes as one text: what it spends on a text is more than on a word.
JOINED = 64


class Memo(dict):
    """Words and what is known of them, bounded by MEMO and MEMO_CHARS (or by what one call of missing() asks for)."""

    chars = 0

    def missing(self, words: set[str]) -> set[str]:
        """Those of these words that have to be put in now; where they would be too many, all are forgotten first."""
        new = set(filterfalse(self.__contains__, words))
        chars = sum(map(len, new))
        if len(self) + len(new) > MEMO or self.chars + chars > MEMO_CHARS:
            self.clear()
            new, self.chars = words, 0
            chars = sum(map(len, new))
        self.chars += chars
        return new


class WordBpe:
    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.one = Tokenizer.from_file(path)  # for a single, already normalised pre-token
        self.one.no_truncation()
        self.one.no_padding()
        self.one.normalizer = None
        self.one.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.one.encode_special_tokens = True
        self.many = Tokenizer.from_str(self.one.to_str())  # for many of them, with spaces between
        self.many.pre_tokenizer = Sequence([CharDelimiterSplit(" "), self.one.pre_tokenizer])
        self.many.encode_special_tokens = True
        self.special = {s: self.full.token_to_id(s) for s in ("<|startoftext|>", "<|endoftext|>")}
        model = json.loads(self.full.to_str())["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ends = {i for token, i in model["vocab"].items() if self.suffix and token.endswith(self.suffix)}
        # Without the suffix that marks a word's end: for pieces that stop inside a word.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.open = Tokenizer(BPE(vocab=model["vocab"], merges=merges))
        self.open.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, array] = Memo()

    def plain(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text) is None:
            return unicodedata.normalize("NFC", text).lower().split()
        norm = self.full.normalizer.normalize_str(text)
        return [OWN + norm[a:b] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(norm)]

    def words(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after the other, are the text's ids.

        In Latin texts they are what white space parts, normalised; in other texts normalised pre-tokens,
        and for the special strings their ids, each behind a mark that no Latin word has.
        """
        if "<|" not in text or SPECIAL.search(text) is None:
            return self.plain(text)
        out, at = [], 0
        for m in SPECIAL.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(f"{SPECIAL_MARK}{self.special[m[0]]}")
            at = m.end()
        return out + self.plain(text[at:])

    def ids_of(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of these normalised pre-tokens, merged by the library, many at once.

        A word's last id, and no other, bears the suffix. Where there aren't as many of those as words (or a word
        may hold a space or the suffix itself), the library takes the words one by one.
        """
        for k in range(0, len(words), 4096):
            lines = [words[j : min(j + JOINED, k + 4096)] for j in range(k, min(k + 4096, len(words)), JOINED)]
            for line, found in zip(lines, self.many.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
                ids, out, start = found.ids, [], 0
                for end, i in enumerate(ids, 1):
                    if i in self.ends:
                        out.append(ids[start:end])
                        start = end
                text = "".join(line)
                if len(out) != len(line) or start != len(ids) or " " in text or "<" in text:
                    out = [x.ids for x in self.one.encode_batch_fast(line, add_special_tokens=False)]
                yield from out

    def made_of(self, words: Iterable[str], make: Callable[[list[int]], object]) -> Iterator[tuple[str, object]]:
        """Each word with what `make` says of its ids; what has to be merged goes to the library in batches."""
        whole, split = [], []
        for word in words:
            (whole if word.isalpha() else split).append(word)
        yield from zip(whole, map(make, self.ids_of(whole)))
        parts = [[w[1:]] if w[0] == OWN else [] if w[0] == SPECIAL_MARK else PRE_TOKEN.findall(w) for w in split]
        known = self.known
        todo = list(known.missing(set(chain.from_iterable(parts))))
        known.update((p, array("I", ids)) for p, ids in zip(todo, self.ids_of(todo)))
        for word, own in zip(split, parts):
            ids = [int(word[1:])] if word[0] == SPECIAL_MARK else known[own[0]] if len(own) == 1 else [i for p in own for i in known[p]]
            yield word, make(ids)


class WordMemo:
    """word -> its ids, unsigned little-endian of 32 bits each; kept between the tasks of a worker."""

    def __init__(self, path: str):
        self.bpe, self.memo = word_bpe(path), Memo()

    def over(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        """For each text, in order, the ids of its words."""
        held, chars = [], 0
        for text in texts:
            held.append(self.bpe.words(text or ""))
            chars += len(text or "")
            if chars >= AT_ONCE:
                yield from self.resolved(held)
                held, chars = [], 0
        yield from self.resolved(held)

    def resolved(self, held: list[list[str]]) -> Iterator[list[bytes]]:
        memo = self.memo
        memo.update(self.bpe.made_of(memo.missing(set().union(*held)), lambda ids: struct.pack(f"<{len(ids)}I", *ids)))
        for own in held:
            yield list(map(memo.__getitem__, own))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def word_memo(path: str) -> WordMemo:
    return WordMemo(path)
