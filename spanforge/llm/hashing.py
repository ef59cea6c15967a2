"""Vectorised hashes over many texts at once (numpy, in tasks)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64, for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = 1 << max(n, 1024).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 sums; see ``substring_hash``."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal strings have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


#: The six white-space bytes that bytes.split() splits at.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the n+1 offsets of each text's words among them."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = WHITE[joined]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(white & ~before)
    hashes = substring_hash(prefix_hash(joined), starts, ends)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, edges)


def shingle_sets(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text, sorted, one after the other, and the n+1 offsets.

    A text with fewer words than ``width`` has its whole word sequence as its only shingle, one without words none.
    """
    hashes, offsets = word_hashes(texts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * U(BASE)) | U(1)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix(rolled)
    sets, sizes = [], [0]
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if high - low >= width:
            own = np.unique(rolled[low : high - width + 1])
        elif high > low:
            own = mix(np.sum(hashes[low:high] * factors[: high - low], dtype=np.uint64, keepdims=True) + U(high - low))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        sizes.append(len(own))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)


def by_bytes(values: Sequence, most: int, size=len) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about ``most`` bytes each."""
    low = total = 0
    for k, value in enumerate(values):
        total += size(value)
        if total >= most:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(values):
        yield low, len(values)
