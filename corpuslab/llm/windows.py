"""Hashes of windows of bytes or words, and the anchors windows are told apart by. Plain arrays, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64 bits over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(base), powers(pow(base, -1, 1 << 64))


class Rolling:
    """Hash of any stretch of a unit sequence from one running sum."""

    def __init__(self, units: np.ndarray, base: int):
        size = 1 << max(18, len(units).bit_length())
        power, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * power[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width))


def byte_units(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64) + np.uint64(1)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    gap = np.concatenate([[True], _IS_GAP[np.frombuffer(raw, np.uint8)], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_units(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first."""
    raw = (text or "").encode()
    raw = raw.translate(_LOWER) if lower else raw
    out, stop = [], 0
    while stop < len(raw):  # parts of a very long text, each from where the one before ends, cut at word starts
        at, stop = stop, min(len(raw), (stop // (1 << 20) + 1) * (1 << 20))
        if stop < len(raw) and not _IS_GAP[raw[stop - 1]]:
            stop = _next_gap(raw, stop)
        part = raw[at:stop]
        starts, ends = word_bounds(part)
        rolling = Rolling(np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1), BASES[1])
        out.append(rolling.of(starts, ends))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _next_gap(raw: bytes, at: int) -> int:
    found = [p for p in (raw.find(bytes([c]), at) for c in (9, 10, 11, 12, 13, 32)) if p >= 0]
    return min(found, default=len(raw))


def _first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its first minimum."""
    place = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = values[:-step], values[step:]
        take = right < left
        values = np.where(take, right, left)
        place = np.where(take, place[step:], place[:-step])
        size += step
    return place


@dataclass
class Anchors:
    """Runs of windows of one document that share an anchor: window starts ``low`` to ``low + count - 1``."""

    row: np.ndarray
    low: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    slice: np.ndarray


def segments(sizes: list[int], width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (row, from, to): documents together up to CHUNK units, longer ones in overlapping parts."""
    held, total = [], 0
    for row, n in enumerate(sizes):
        for at in range(0, max(0, n - width + 1), CHUNK):
            part = (row, at, min(n, at + CHUNK + width - 1))
            if held and total + part[2] - at > CHUNK:
                yield held
                held, total = [], 0
            held.append(part)
            total += part[2] - at
    if held:
        yield held


def anchors(rows: list[np.ndarray], width: int, gram: int) -> Iterator[Anchors]:
    """Anchor of a window: its ``gram`` units of smallest hash, the first of equals.

    Equal windows have equal anchors at equal places, so repeats need only be sought among windows of one anchor.
    ``slice`` hashes all units of a run's windows.
    """
    for chunk in segments([len(r) for r in rows], width):
        units = np.concatenate([rows[r][a:b] for r, a, b in chunk])
        lengths = np.array([b - a for _, a, b in chunk])
        begin = np.cumsum(lengths) - lengths
        first, second = Rolling(units, BASES[0]), Rolling(units, BASES[1])
        grams = first.every(gram)
        place = _first_minimum(grams, width - gram + 1)
        part = np.repeat(np.arange(len(chunk)), lengths)[: len(place)]
        inside = np.arange(len(place)) - begin[part] <= lengths[part] - width
        starts = np.flatnonzero(inside)
        at = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (part[starts[1:]] != part[starts[:-1]])
        head = np.flatnonzero(new)
        low = starts[head]
        count = np.diff(np.append(head, len(starts)))
        owner = part[low]
        row = np.array([c[0] for c in chunk])[owner]
        offset = np.array([c[1] for c in chunk]) - begin
        code = second.of(low, low + count - 1 + width) ^ mix((at[head] - low).astype(np.uint64) + np.uint64(7))
        yield Anchors(row, low + offset[owner], count, grams[at[head]].view(np.int64), code.view(np.int64))


def window_hashes(units: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window."""
    return Rolling(units, BASES[0]).every(width).view(np.int64), Rolling(units, BASES[1]).every(width).view(np.int64)
