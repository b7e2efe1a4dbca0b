"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Odd factors for the place of a byte in its word; beyond the table they repeat.
_PLACE = _random.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_ORDER = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_list(text: str | None) -> list[bytes]:
    """Words between white space 0x20, 0x09-0x0D, with A-Z in lower case."""
    return text.encode("utf-8").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(_BYTE[data] * _PLACE[place & (len(_PLACE) - 1)], begins)
    return mixed(sums + lengths.astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words as one, if
    there are fewer; none without words."""
    words = word_hashes(word_list(text))
    if not len(words):
        return words
    if len(words) < WIDTH:
        return mixed((words * _ORDER[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + n] * _ORDER[k]
    return np.unique(mixed(total))
