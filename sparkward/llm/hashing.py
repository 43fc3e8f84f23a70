"""Hashes of words and of word sequences, vectorised over a batch of texts inside a task.

A word's hash is the sum of a random number for each of its bytes and that byte's place: over the choice
of the numbers any two words, whatever they hold, share a hash with a chance of 2 ** -64. Words longer than
LONGEST bytes are hashed by BLAKE2b instead.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the longest word that the table covers, and the table: a row of 256 numbers for each place.
LONGEST = 64
TABLE = np.random.default_rng(20_240_229).integers(0, 1 << 64, size=LONGEST * 256, dtype=np.uint64)
#: Texts are hashed together up to about so many bytes.
AT_ONCE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where in them each text starts (one more at the end)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    start, stop = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.r_[0, np.searchsorted(start, ends)]
    if not len(start):
        return np.empty(0, np.uint64), bounds
    size = stop - start
    at = np.flatnonzero(~space)
    first = np.cumsum(size) - size
    place = np.minimum(at - np.repeat(start, size), LONGEST - 1)
    hashes = np.add.reduceat(TABLE[place << 8 | data[at]], first) + size.astype(np.uint64)
    for k in np.flatnonzero(size > LONGEST).tolist():
        hashes[k] = int.from_bytes(blake2b(joined[start[k] : stop[k]], digest_size=8).digest(), "little")
    return mix(hashes), bounds


def in_batches(rows: list[tuple[int, str | None]]):
    """(ids, texts as bytes) of rows, about AT_ONCE bytes at a time."""
    ids, texts, size = [], [], 0
    for own, text in rows:
        data = (text or "").encode()
        ids.append(own)
        texts.append(data)
        size += len(data)
        if size >= AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i, mixed. Put together from powers of two."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n, done, out, power, width, step = len(h) - k + 1, 0, None, h, 1, BASE
    while k:
        if k & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, width, 1 << 64)) + part
            done += width
        k >>= 1
        if k:
            power = power[: len(power) - width] * np.uint64(step) + power[width:]
            step, width = step * step % (1 << 64), 2 * width
    return mix(out)
