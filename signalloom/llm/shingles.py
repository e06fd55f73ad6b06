"""Sets of word shingles, as sorted 64-bit values, computed with vector operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(0, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_CHAIN = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Texts are handled in groups of about this many bytes; only the size of temporary arrays depends on it.
GROUP_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every other."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grouped(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append((text or "").encode())
        held += len(group[-1]) + 1
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def shingle_sets(texts: Sequence[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct values of its shingles of ``words`` words, lower-cased in A-Z.

    A text of fewer words has its whole sequence as the only shingle; without words the set is empty.
    """
    for group in _grouped(texts):
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        lengths = np.array([len(g) + 1 for g in group], np.int64)
        ends_of_text = np.cumsum(lengths)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(space & ~before)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:])
        values = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.concatenate([[0], ends_of_text[:-1]]))
        last = np.concatenate([first[1:], [len(starts)]])
        if len(values) >= words:
            chained = values[: len(values) - words + 1].copy()
            for k in range(1, words):
                chained = chained * _CHAIN + values[k : len(values) - words + 1 + k]
            chained = mixed(chained)
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= words:
                ordered = np.sort(chained[a : b - words + 1])
                yield ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
            elif b > a:
                whole = _U(b - a)
                with np.errstate(over="ignore"):
                    for v in values[a:b]:
                        whole = whole * _CHAIN + v
                yield mixed(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)
