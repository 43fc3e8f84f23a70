"""Words that the library merges many at once: the ids that it gives for each alone, in far fewer texts."""

import gc
import random
import struct
import tracemalloc

import public_tokenizers

from sparkward.llm import bpe, word_bpe


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_merged_many_at_once():
    bpe, draw = word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    letters = [*map(chr, range(97, 123)), "é", "ß", "ı", "日", "語"]
    words = list(dict.fromkeys("".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(6400)))
    odd = ["", "a b", "</w>", "x</w>y", "<|endoftext|>", " ", "\x00", "\U0001f600", "1", "'s"]
    bpe.one = Counted(bpe.one)
    got = dict(bpe.made_of(words, tuple))
    assert bpe.one.texts == 0  # each word was a text of its own before
    alone = lambda ws: [x.ids for x in bpe.one.encode_batch_fast(ws, add_special_tokens=False)]
    assert got == dict(zip(words, map(tuple, alone(words))))
    mixed = words[:300] + odd + words[300:500]
    assert list(bpe.ids_of(mixed)) == alone(mixed)


def held(make):
    """MB that Python objects hold more after make()."""
    gc.collect()
    tracemalloc.start()
    make()
    gc.collect()
    try:
        return tracemalloc.get_traced_memory()[0] / 2**20
    finally:
        tracemalloc.stop()


def test_leaves_remember_words_in_little_memory():
    """A worker keeps the memo of leaves beside that of short texts: few bytes a word, and bounded for long words too."""
    tree, draw = bpe.Tree(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)

    def leaves(n, length):
        for _ in range(n):
            tree.leaf(" ".join("".join(draw.choices("abcdefghij", k=length)) for _ in range(16_000 // (length + 1))), 0)

    mb = held(lambda: leaves(20, 7))
    assert mb * 2**20 / len(tree.memo) < 200  # 323 before
    leaves(400, 2600)  # 6.2 million characters in 2,400 words, all kept before
    assert sum(map(len, tree.memo)) <= word_bpe.MEMO_CHARS


def test_what_is_forgotten_is_merged_again(monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO", 40)
    monkeypatch.setattr(word_bpe, "AT_ONCE", 300)
    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    tree, memo = bpe.Tree(path), word_bpe.WordMemo(path)
    texts = [" ".join("".join(draw.choices("abc,'s", k=draw.randint(1, 4))) for _ in range(draw.choice([0, 3, 30, 200]))) for _ in range(60)]
    want = [tree.bpe.full.encode(t, add_special_tokens=False).ids for t in texts]
    got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in map(b"".join, memo.over(texts))]
    assert got == want == [tree.leaf(t, 0)[0].tolist() for t in texts]
    assert len(memo.memo) < sum(len(set(t.split())) for t in texts) / 4
