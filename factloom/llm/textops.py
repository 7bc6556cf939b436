"""Vectorised text primitives on UTF-8 bytes: many documents at once in one buffer.

Hashes are polynomial prefix sums modulo 2^64 finished by a 64-bit mixer, so the hash of any byte
range costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, dtype=np.uint64)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE_INVERSE, dtype=np.uint64)]), dtype=np.uint64)
    return _powers, _inverses


def forget() -> None:
    """Drops powers kept for long buffers."""
    global _powers, _inverses
    _powers, _inverses = _powers[:1].copy(), _inverses[:1].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of consecutive documents of about `most` bytes together; longer ones stand alone."""
    start, size, group = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > most:
            yield start, group
            start, size, group = i, 0, []
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield start, group


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of uint64 values, from which range_hash() takes the hash of any of their ranges."""
    up, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    return sums(buf.astype(np.uint64) + np.uint64(1))


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes (or values) from start to end, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(group: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) of each document, and how many each has."""
    buf = np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    lengths = np.fromiter((len(x) + 1 for x in group), dtype=np.int64, count=len(group))
    space = SPACES[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    # buf ends with white space, so edges come in pairs: start, end
    start, end = edge[0::2], edge[1::2]
    hashes = range_hash(prefix_hash(buf), start, end) if len(start) else np.empty(0, dtype=np.uint64)
    bounds = np.cumsum(lengths)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds, "left")]))
    return hashes, counts


#: Letters and digits, and every byte from 0x80.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits of each document (A-Z lowered), and how many each has."""
    buf = LOWER[np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ALNUM[buf]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    hashes = range_hash(prefix_hash(buf), start, end) if len(start) else np.empty(0, dtype=np.uint64)
    bounds = np.cumsum([len(x) + 1 for x in group])
    return hashes, np.diff(np.searchsorted(start, bounds, "left"), prepend=0)


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document its sorted distinct terms and how often each occurs."""
    for _, group in buffers(texts):
        hashes, counts = terms(group)
        for end, n in zip(np.cumsum(counts), counts, strict=True):
            yield np.unique(hashes[end - n : end], return_counts=True)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct shingle hashes.

    A document with fewer than `width` words has its whole sequence as one shingle; one without
    words, or null, has none.
    """
    for _, group in buffers(texts):
        hashes, counts = words(group)
        ends = np.cumsum(counts)
        full = np.zeros(len(hashes), dtype=np.uint64)
        n = len(hashes) - width + 1
        if n > 0:
            acc = np.full(n, width, dtype=np.uint64)
            for j in range(width):
                acc = mix(acc * np.uint64(BASE) + hashes[j : j + n])
            full[:n] = acc
        for end, count in zip(ends, counts, strict=True):
            if count >= width:
                yield np.unique(full[end - count : end - width + 1])
            elif count:
                acc = np.full(1, count, dtype=np.uint64)
                for j in range(count):
                    acc = mix(acc * np.uint64(BASE) + hashes[end - count + j : end - count + j + 1])
                yield acc
            else:
                yield np.empty(0, dtype=np.uint64)
