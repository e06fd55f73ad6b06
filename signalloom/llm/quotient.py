"""Counting quotient filters as plain values that tasks build, ship and merge.

A fingerprint of ``bits`` bits is cut into a quotient (its high bits) and a remainder. Remainders of one quotient stand
in ascending order in a run of slots at or after the slot of that number. Three bits describe a slot: whether its number
is the quotient of some run, whether a run ends in it, and whether it holds a digit of the count of the remainder before
it rather than a remainder. Remainders that occur once need no digit, so a filter of distinct values costs the remainder
and three bits a slot. Nothing is lost: ``entries`` gives back every fingerprint with its count, in ascending order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from signalloom.llm.common import pack, unpack

_NONE = np.empty(0, np.uint64)


def _widths(bits: int) -> type:
    return next(kind for size, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if bits <= size)


@dataclass
class QuotientFilter:
    bits: int
    quotient_bits: int
    slots: np.ndarray
    occupied: np.ndarray
    run_end: np.ndarray
    digit: np.ndarray

    @classmethod
    def build(cls, bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> "QuotientFilter":
        """From distinct ascending fingerprints below 2**bits and their counts, all at least 1."""
        n = len(fingerprints)
        quotient_bits = min(bits, max(1, int(n).bit_length()))
        low = bits - quotient_bits
        quotients = (fingerprints >> np.uint64(low)).astype(np.int64) if n else np.empty(0, np.int64)
        remainders = fingerprints & np.uint64((1 << low) - 1) if n else _NONE
        base = max(low, 8)
        # Digits of count - 1, lowest first; a count of 1 has none.
        rest = counts.astype(np.uint64) - np.uint64(1) if n else _NONE
        digits = np.zeros(n, np.int64)
        left = rest.copy()
        while left.any():
            digits += left > 0
            left = left >> np.uint64(base) if base < 64 else np.zeros_like(left)
        size = 1 + digits
        owner = np.repeat(np.arange(n), size)
        start = np.cumsum(size) - size
        nth = np.arange(len(owner)) - start[owner]
        shift = np.minimum((np.maximum(nth, 1) - 1) * base, 63).astype(np.uint64)
        mask = np.uint64((1 << base) - 1) if base < 64 else np.uint64(2**64 - 1)
        values = np.where(nth == 0, remainders[owner], (rest[owner] >> shift) & mask) if n else _NONE
        # A slot is the later of the quotient and the slot after the one before.
        order = np.arange(len(owner))
        place = np.maximum.accumulate(quotients[owner] - order) + order if n else order
        length = max(1 << quotient_bits, int(place[-1]) + 1 if n else 0)
        slots = np.zeros(length, _widths(base))
        slots[place] = values.astype(slots.dtype)
        occupied, run_end, digit = (np.zeros(length, bool) for _ in range(3))
        occupied[quotients] = True
        last = np.ones(len(owner), bool)
        last[:-1] = quotients[owner][1:] != quotients[owner][:-1]
        run_end[place[last]] = True
        digit[place] = nth > 0
        return cls(bits, quotient_bits, slots, occupied, run_end, digit)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, and how often each was counted."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(quotients):
            return _NONE, np.empty(0, np.int64)
        starts = np.maximum(quotients, np.concatenate([[-1], ends[:-1]]) + 1)
        size = ends - starts + 1
        owner = np.repeat(np.arange(len(quotients)), size)
        place = starts[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
        low, base = self.bits - self.quotient_bits, max(self.bits - self.quotient_bits, 8)
        head = ~self.digit[place]
        values = self.slots[place].astype(np.uint64)
        high = quotients[owner][head].astype(np.uint64)
        fingerprints = (high << np.uint64(low) if low < 64 else np.zeros_like(high)) | values[head]
        first = np.flatnonzero(head)
        nth = np.arange(len(place)) - first[np.cumsum(head) - 1]
        shift = np.minimum((np.maximum(nth, 1) - 1) * base, 63).astype(np.uint64)
        return fingerprints, np.add.reduceat(np.where(head, np.uint64(1), values << shift), first).astype(np.int64)

    def to_bytes(self) -> bytes:
        return pack(
            np.array([self.bits, self.quotient_bits, len(self.slots)], np.int64), self.slots,
            *(np.packbits(x) for x in (self.occupied, self.run_end, self.digit)),
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> "QuotientFilter":
        head, slots, *flags = unpack(data)
        bits, quotient_bits, length = (int(x) for x in head)
        return cls(bits, quotient_bits, slots, *(np.unpackbits(x, count=length).astype(bool) for x in flags))


def add_up(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending fingerprints with their counts added up; runs that are in order already are merged."""
    if not len(fingerprints):
        return _NONE, np.empty(0, np.int64)
    order = np.argsort(fingerprints, kind="stable")
    ordered = fingerprints[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(counts[order], first)


def merge(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter with the counts of all: their entries come out sorted and are merged in that order."""
    found = [f.entries() for f in filters]
    return QuotientFilter.build(
        filters[0].bits if filters else 64,
        *add_up(np.concatenate([f for f, _ in found] or [_NONE]), np.concatenate([c for _, c in found] or [np.empty(0, np.int64)])),
    )
