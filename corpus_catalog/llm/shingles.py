"""Hashes of word shingles for whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes hashed at a time; a longer text is hashed in segments that end between words.
SEGMENT = 2_000_000

_random = np.random.default_rng(20_240_229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_WORD = _random.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FULL = np.multiply(_WORD[WIDTH:], np.uint64(WIDTH))
_BASE = int(_random.integers(1, 2**62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        each = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            column = np.full(max(n, SEGMENT + 4096), base, np.uint64)
            column[0] = 1
            each.append(np.cumprod(column, dtype=np.uint64))
        _powers = each[0], each[1]
    return _powers


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of some UTF-8 bytes, letters A-Z as a-z."""
    if len(data) <= SEGMENT:
        return _segment_words(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:  # one word longer than a segment
                after = next(
                    (i + int(s[0]) + 1 for i in range(stop, len(data), SEGMENT) if len(s := np.flatnonzero(_SPACE[data[i : i + SEGMENT]]))),
                    len(data),
                )
                stop = after
        start, end, value = _segment_words(data[at:stop])
        parts.append((start + at, end + at, value))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_groups(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of words that lie in ascending groups: group and hash of each shingle.

    A group of fewer words than a shingle has gives one shingle of them all.
    """
    n = len(value)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = max(0, n - WIDTH + 1)
    total = np.zeros(full, np.uint64)
    for k in range(WIDTH):
        total += value[k : k + full] * _WORD[k]
    same = group[:full] == group[WIDTH - 1 :][:full]
    owner, found = group[:full][same], mix(total[same] + _FULL)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    short = size < WIDTH
    if short.any():
        small = np.zeros(int(short.sum()), np.uint64)
        for k in range(WIDTH - 1):
            has = size[short] > k
            small[has] += value[first[short][has] + k] * _WORD[k]
        small = mix(small + size[short].astype(np.uint64) * _WORD[WIDTH])
        owner, found = np.r_[owner, group[first[short]]], np.r_[found, small]
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    return owner, found.view(np.int64)


def chunks(texts: list[bytes], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together, at least one text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def text_shingles(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text, in order: its place and its shingles' distinct hashes, sorted."""
    for begin, stop in chunks(texts):
        joined = np.frombuffer(b"\n".join(texts[begin:stop]) + b"\n", np.uint8)
        start, _, value = words(joined)
        ends = np.cumsum([len(t) + 1 for t in texts[begin:stop]])
        group = np.searchsorted(ends, start, side="right")
        owner, found = shingle_groups(group, value)
        cut = np.searchsorted(owner, np.arange(stop - begin + 1))
        for i in range(stop - begin):
            yield begin + i, np.unique(found[cut[i] : cut[i + 1]])


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell one set of hashes from any other."""
    own = values.view(np.uint64)
    each = (mix(own + np.uint64(1)).sum(), mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum())
    return tuple(int(x.astype(np.uint64).view(np.int64)) for x in each)


def line_shingles(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: its number of words; of all lines: line and hash of the distinct shingles, sorted."""
    data = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    start, _, value = words(data)
    line = np.searchsorted(ends, start)
    owner, found = shingle_groups(line, value)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])][: len(owner)]
    return np.bincount(line, minlength=len(ends)), owner[fresh], found[fresh]
