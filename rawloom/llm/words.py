"""Words of UTF-8 texts and their 64-bit hashes, for whole blocks of texts at once in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Random weights of the bytes, from a fixed seed.
_WEIGHT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_P, _P_INV)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads a hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """data: the texts with a separator after each; starts, ends: of the words in data; doc: the text's index;
    hashes: of the words after folding; first: for each text the index of its first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word (of all of a shorter one)."""
        down = _powers(len(self.data) + 1)[1]
        return mix((self.sums[np.minimum(self.starts + n, self.ends)] - self.sums[self.starts]) * down[self.starts] + np.uint64(n))

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: ASCII, and the capital letters of Latin-1 in UTF-8."""
    out = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[lead] += 0x20
    return out


def words(texts: list[bytes]) -> Words:
    """The words of texts: runs of letters and digits (any byte beyond ASCII counts as a letter), with a point or
    comma between two digits.  Hashes are of the word in lower case."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))).astype(np.int64)
    inside = _WORD[data]
    if len(data) > 2:
        digit = (data >= 48) & (data <= 57)
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHT[folded(data)] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, hashes, np.searchsorted(starts, offsets), offsets, sums)


def word_hash(text: str) -> int:
    """The hash of one word."""
    found = words([text.encode()])
    if len(found.hashes) != 1:
        raise ValueError(f"not one word: {text!r}")
    return int(found.hashes[0])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order; the caller drops runs that cross from text to text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
