"""Words of many texts at once as numpy arrays: byte offsets, document index and 64-bit hashes.

A word is a run of bytes outside space and 0x09-0x0D. All separators are ASCII, so UTF-8 bytes can be cut like
characters. Texts are handled in chunks of a few megabytes, whole texts always in one chunk, so that the arrays stay small
beside the texts whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: A little below a power of two, up to which tables of powers are kept.
CHUNK_BYTES = (1 << 20) - (32 << 10)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n; ``base`` is odd."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        have = _POWERS[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


@dataclass
class Words:
    """``first:first + count`` are the texts of the batch covered; words of text k are ``bounds[k]:bounds[k + 1]``."""

    first: int
    data: bytes
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray
    sums: np.ndarray | None = None

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of the first ``size`` bytes of every word that has as many."""
        at = np.flatnonzero(self.end - self.start >= size)
        begin = self.start[at]
        return at, mix((self.sums[begin + size] - self.sums[begin]) * _powers(_BASE, len(self.sums))[1][begin] + np.uint64(size))

    @property
    def count(self) -> int:
        return len(self.bounds) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), np.diff(self.bounds))

    def windows(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of every run of ``n`` words that lies in one text."""
        total = len(self.hash)
        if total < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = _powers(_STEP[which], total + 1)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(self.hash * up[:total], out=sums[1:])
        doc = self.doc
        at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
        return at, mix((sums[at + n] - sums[at]) * down[at])


def _words(first: int, parts: list[bytes], lower: bool) -> Words:
    data = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    up, down = _powers(_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.take(_TABLE, raw, out=sums[1:])
    sums[1:] *= up[: len(raw)]
    np.cumsum(sums, out=sums)
    value = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(first, data, start, end, bounds, value, sums)


def chunks(texts: list[str | None], lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Cover ``texts`` (null: no words) in order; ``lower`` hashes A-Z as a-z."""
    first, parts, total = 0, [], 0
    for k, text in enumerate(texts):
        part = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if parts and total + len(part) > size:
            yield _words(first, parts, lower)
            first, parts, total = k, [], 0
        parts.append(part)
        total += len(part)
    if parts:
        yield _words(first, parts, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
