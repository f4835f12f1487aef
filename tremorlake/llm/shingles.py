"""Word shingles of many documents at once, as 64-bit hashes, in numpy.

Word hashes come from prefix sums of a polynomial over random byte values modulo 2**64 and a finishing mix,
shingle hashes from those of their words.  Two different shingles share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Joins documents in one buffer; it is white space.
GAP = b"\n"
BASE = np.uint64(0x9E3779B97F4A7C17)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known finisher: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def power_table(n: int, base: np.uint64) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return powers(size, int(base))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times BASE**i."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * power_table(len(data), BASE)[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * power_table(len(sums), INVERSE)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, A-Z lower-cased, and the index in texts of the word's text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((GAP.join(raw) + GAP).translate(LOWERED), np.uint8)
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    limits = np.cumsum([len(r) + 1 for r in raw])
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(limits, starts, side="right")


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles of k words; fewer words are one shingle."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    factors = mix(np.arange(11, 11 + k, dtype=np.uint64))
    if len(words) >= k:
        n = len(words) - k + 1
        sums = words[:n] * factors[0]
        for j in range(1, k):
            sums = sums + words[j : j + n] * factors[j]
        hashed = mix(sums)
    else:
        hashed = np.empty(0, np.uint64)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(hashed[at : at + n - k + 1])
        elif n:
            yield mix(np.array([(words[at : at + n] * factors[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += n


def in_slices(texts: list[str], chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about that many characters, so that a batch of long documents stays small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]
