"""Vectorised 64-bit hashes of words and runs of words, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
STRIP = 1 << 19

_BLANKS = [9, 10, 11, 12, 13, 32]
_BLANK = np.isin(np.arange(256), _BLANKS)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
EMPTY = np.zeros(0, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes free of blanks."""
    solid = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return EMPTY, starts
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    power = np.full(int(sizes.max()), _ODD, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(_BYTE[data[solid]] * power[place], first)
    return mixed(h + sizes.astype(np.uint64) * _ODD), starts


def _long(text: bytes) -> np.ndarray:
    """Words of a text longer than a strip, cut at blanks."""
    found, at = [], 0
    while at < len(text):
        end = min(at + STRIP, len(text))
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        found.append(_words(np.frombuffer(text, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(found)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order; null counts as empty."""
    rows: list[bytes] = []
    size = 0

    def flushed() -> Iterator[np.ndarray]:
        if not rows:
            return
        if len(rows) == 1 and len(rows[0]) > STRIP:
            yield _long(rows[0])
            return
        data = np.frombuffer(b" ".join(rows), dtype=np.uint8)
        begins = np.cumsum([0] + [len(r) + 1 for r in rows])
        hashes, starts = _words(data)
        cuts = np.searchsorted(starts, begins)
        for i in range(len(rows)):
            yield hashes[cuts[i] : cuts[i + 1]]

    for value in texts:
        raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
        if rows and size + len(raw) > STRIP:
            yield from flushed()
            rows, size = [], 0
        rows.append(raw)
        size += len(raw)
    yield from flushed()


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; shorter texts have none."""
    m = len(words) - n + 1
    if m <= 0:
        return EMPTY
    h = words[:m]
    for k in range(1, n):
        h = mixed(h * _ODD + np.uint64(k)) + words[k : k + m]
    return mixed(h)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct runs of n words; of a shorter text its whole sequence, of an empty one none."""
    if 0 < len(words) < n:
        return runs(words, len(words))
    h = np.sort(runs(words, n))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h
