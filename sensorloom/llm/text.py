"""Whole texts as numpy arrays: words, their 64-bit hashes and k-grams, for a bounded number of bytes at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def pieces(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive items of together at most ``limit`` bytes; a larger item stands alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


def encoded(texts, table: bytes | None = None) -> list[bytes]:
    """UTF-8 of every text (null: empty), through a byte translation table if one is given."""
    out = [t.encode() if isinstance(t, str) else b"" for t in texts]
    return [t.translate(table) for t in out] if table else out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        size = 1 << max(20, math.ceil(math.log2(n)))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        if size > 4 * CHUNK_BYTES:  # one very long text: not kept
            return np.cumprod(steps)[:n]
        _POWERS[name] = np.cumprod(steps)
    return _POWERS[name][:n]


class Words:
    """Words of some texts: ``hash``, ``doc`` (index of the text), ``start``/``end`` in ``buffer``; ``first[i]`` to ``first[i+1]`` are those of text i.

    A word is a run of bytes other than space and 0x09-0x0D.
    """

    def __init__(self, texts: Sequence[bytes]):
        self.buffer = b" ".join([*texts, b""]) or b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(raw)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers("down", _INVERSE, len(raw))[self.start])

    def __len__(self) -> int:
        return len(self.hash)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of ``k`` words inside one text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= factor
        out += hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text of each, by text; a shorter text is one run, one without words has none."""
    value, at = grams(words.hash, words.doc, k)
    values, docs = [value], [words.doc[at]]
    counts = np.diff(words.first)
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            run = np.zeros(len(short), np.uint64)
            for j in range(size):
                run = mix(run + words.hash[words.first[short] + j])
            values.append(run)
            docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]
