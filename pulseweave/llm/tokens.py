"""Words of many texts at once, as 64-bit hashes of their code points.

A batch of texts becomes one array of code points.  A running sum of ``code * BASE**i``
(modulo 2**64) gives the hash of any substring from two entries, so words, shingles and
character n-grams cost a few array operations each.  A text is never cut: one that is
longer than ``CHUNK`` makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache
def ascii_words() -> tuple[np.ndarray, np.ndarray]:
    """Tables for words between ASCII white space, with A-Z in lower case."""
    word = np.ones(0x110000, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[0x41:0x5B] += 32
    return word, lower


@lru_cache
def letter_words() -> tuple[np.ndarray, np.ndarray]:
    """Tables for runs of letters, each letter in lower case where that is one letter."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    word = np.array([c.isalpha() for c in chars])
    small = [c.lower() for c in chars]
    lower = np.array([ord(s) if len(s) == 1 else ord(c) for c, s in zip(chars, small)], np.uint32)
    return word, lower


class Words:
    """Words of a run of texts: code points, word borders, words per text."""

    def __init__(self, texts: list[str], tables: tuple[np.ndarray, np.ndarray]):
        word, lower = tables
        joined = " ".join(texts) + " "
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(lengths)
        self.codes = lower[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = word[raw]
        inside[self.text_ends] = False  # the blank after each text, shifted by one
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        first = np.searchsorted(self.starts, self.text_ends)
        self.counts = np.diff(first, prepend=0)
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings between code points ``starts`` and ``ends``."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)


def runs(texts: list[str | None], chunk: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Cut a list of texts into runs of about ``chunk`` characters: (first index, texts)."""
    first, size, run = 0, 0, []
    for k, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > chunk:
            yield first, run
            first, size, run = k, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
