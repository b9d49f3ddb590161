"""Duplicate checks by sequence number: an exact sliding window and a Bloom filter of two generations."""

from __future__ import annotations

import math

import numpy as np

NEW, RESET, DUPLICATE, TOO_OLD = "new", "reset", "duplicate", "too_old"


class WindowDedup:
    """The numbers of one producer seen within ``window`` of the highest.

    A number above the highest is new. One that lies ``window`` or more behind is too old, which also
    counts as a duplicate, unless it lies ``reset`` or more behind: then the producer started
    again, and so does the window.
    """

    __slots__ = ("window", "reset", "highest", "seen")

    def __init__(self, window: int = 4096, reset: int = 1_000_000, highest: int | None = None, seen: np.ndarray | None = None):
        if window <= 0 or window % 64:
            raise ValueError("the window must be a positive multiple of 64")
        self.window, self.reset, self.highest = window, reset, highest
        self.seen = np.empty(0, np.int64) if seen is None else seen  # sorted, within the window

    def check(self, numbers: np.ndarray) -> np.ndarray:
        """The verdict on each number, in order of arrival; many at once."""
        numbers = np.asarray(numbers, np.int64)
        codes = np.zeros(len(numbers), np.int8)
        at = 0
        while at < len(numbers):
            rest = numbers[at:]
            before = np.empty_like(rest)
            before[0] = self.highest if self.highest is not None else rest[0] - 1
            np.maximum.accumulate(rest[:-1], out=before[1:])
            np.maximum(before[1:], before[0], out=before[1:])
            behind = before - rest
            again = np.flatnonzero(behind >= self.reset)
            n = int(again[0]) if len(again) else len(rest)
            if n:
                self._accept(rest[:n], behind[:n], codes[at : at + n])
            at += n
            if n < len(rest):
                codes[at] = 1
                self.highest, self.seen = int(numbers[at]), numbers[at : at + 1].copy()
                at += 1
        return _VERDICTS[codes]

    def _accept(self, numbers: np.ndarray, behind: np.ndarray, codes: np.ndarray) -> None:
        above = behind < 0  # a new highest number; these rise, so they are sorted
        low = np.flatnonzero(~above)
        if len(low):
            x = numbers[low]
            repeated = np.ones(len(x), bool)
            repeated[np.unique(x, return_index=True)[1]] = False
            repeated |= _among(x, numbers[above]) | _among(x, self.seen)
            codes[low[repeated]] = 2
            codes[low[behind[low] >= self.window]] = 3
        self.highest = int(max(numbers.max(), self.highest if self.highest is not None else numbers[0]))
        edge = self.highest - self.window
        self.seen = np.unique(np.concatenate([self.seen[self.seen > edge], numbers[numbers > edge]]))


_VERDICTS = np.array([NEW, RESET, DUPLICATE, TOO_OLD], dtype=object)


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def bloom_size(expected: int, false_rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter."""
    bits = int(-expected * math.log(false_rate) / math.log(2) ** 2)
    return bits, max(1, int(bits / expected * math.log(2)))


def fnv1a(data: bytes) -> int:
    """The 32-bit FNV-1a hash as a signed number."""
    # Offset basis and prime of 32-bit FNV-1a.
    h = 0x811C9DC5
    for byte in data:
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def string_hash(text: str) -> int:
    """The JVM's hash of a string, a signed 32-bit number."""
    h = 0
    for c in text:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


class BloomDedup:
    """Two generations of a Bloom filter for one producer; the older is dropped when the newer is full.

    Never passes a repeated number that is among the last ``expected`` insertions; now and then takes a new one for
    repeated.
    """

    def __init__(self, expected: int = 100_000, false_rate: float = 0.001):
        self.expected = expected
        self.bits, self.hashes = bloom_size(expected, false_rate)
        self.now, self.before = np.zeros(self.bits, bool), np.zeros(self.bits, bool)
        self.first = np.zeros(self.bits, np.int32)  # scratch of one call
        self.insertions = self.rotations = 0

    def _places(self, producer: str, numbers: np.ndarray) -> np.ndarray:
        """The bits of each key ``producer:number``, by double hashing in 32-bit arithmetic; a row for each number."""
        head = f"{producer}:"
        one, two = np.full(len(numbers), fnv1a(head.encode()), np.int32), np.full(len(numbers), string_hash(head), np.int32)
        if len(numbers) and numbers.min() >= 0:
            power = 10 ** (len(str(int(numbers.max()))) - 1)
            while power:  # from the first digit on
                digit = ((numbers // power) % 10 + 48).astype(np.int32)
                on = (numbers >= power) if power > 1 else True
                np.copyto(one, (one ^ digit) * np.int32(0x01000193), where=on)
                np.copyto(two, two * np.int32(31) + digit, where=on)
                power //= 10
        else:
            text = numbers.astype("U")
            for c in text.view(np.int32).reshape(len(numbers), -1).T:  # one column for each character, 0 past the end
                on = c != 0
                one[on] = (one[on] ^ c[on]) * np.int32(0x01000193)
                two[on] = two[on] * np.int32(31) + c[on]
        steps = np.arange(self.hashes, dtype=np.int32)
        return np.abs(np.fmod(one[:, None] + steps * two[:, None], np.int32(self.bits)).astype(np.int64))

    def check(self, producer: str, numbers: np.ndarray) -> np.ndarray:
        """Whether each number, in order of arrival, seems to have come before; many at once."""
        numbers = np.asarray(numbers, np.int64)
        out = np.zeros(len(numbers), bool)
        at, step = 0, 20_000
        while at < len(numbers):
            at += self._some(self._places(producer, numbers[at : at + step]), out[at : at + step])
        return out

    def _some(self, places: np.ndarray, out: np.ndarray) -> int:
        """Decide on as many rows as come before the filter is full; how many."""
        old = self.before[places].all(axis=1)
        row = np.flatnonzero(~old)
        own = places[row]
        # a bit counts as set if it is in the filter, or a row before set it: written backwards, the first row stays
        self.first[own[::-1].ravel()] = np.repeat(row[::-1], self.hashes)
        known = (self.now[own] | (self.first[own] < row[:, None])).all(axis=1)
        new = row[~known]
        n = len(places) if len(new) < self.expected - self.insertions else int(new[self.expected - self.insertions - 1]) + 1
        new = new[new < n]
        out[:n] = True
        out[new] = False
        self.now[places[new].ravel()] = True
        self.insertions += len(new)
        if self.insertions >= self.expected:
            self.before, self.now = self.now, np.zeros(self.bits, bool)
            self.insertions, self.rotations = 0, self.rotations + 1
        return n

    def is_duplicate(self, producer: str, number: int) -> bool:
        return bool(self.check(producer, np.array([number]))[0])
