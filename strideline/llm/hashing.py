"""Vectorised word hashes of a block of texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd 64-bit base and its inverse modulo 2**64, and the block size in bytes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
BLOCK_BYTES = 1 << 20

_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0, ..., base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low entropy over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Powers that a worker keeps for its next buffers, for each base; those of a longer buffer are computed anew.
KEPT_POWERS = 1 << 22
_kept: dict[int, np.ndarray] = {}


def _kept_powers(base: np.uint64, n: int) -> np.ndarray:
    """``powers``, kept up to ``KEPT_POWERS``; not to be written to."""
    if n > KEPT_POWERS:
        return powers(base, n)
    got = _kept.get(int(base))
    if got is None or len(got) < n:
        _kept[int(base)] = got = powers(base, n)
    return got[:n]


class Spans:
    """Hashes of byte ranges of one buffer, each by two look-ups."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * _kept_powers(_BASE, n), out=self.sums[1:])
        self.back = _kept_powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """``hash`` of every range of ``width`` bytes."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def blocks(texts: list[str], size: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Runs of whole texts of about ``size`` characters; a longer text is a block of its own."""
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def buffer_of(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes, each followed by a line feed, and each text's first byte."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=first[1:])
    return (_LOWER[data] if lower else data), first


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edge[::2], edge[1::2]


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hash of every word (``lower``: A-Z lower-cased), and where each text's words begin."""
    data, first = buffer_of(texts, lower)
    start, end = runs(~_BLANK[data])
    return Spans(data).hash(start, end), np.searchsorted(start, first)


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of equally long arrays of hashes."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mixed(out * _BASE + p)
    return out
