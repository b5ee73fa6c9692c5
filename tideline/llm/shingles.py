"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = _mix((np.arange(WORDS + 1, dtype=np.uint64) + np.uint64(1000)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def second_order(hashes: np.ndarray) -> np.ndarray:
    """Another order of the same shingles, independent of their hash order."""
    return _mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes; words are runs of anything but ASCII white space."""
    x = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[x]
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts = edge[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(x))
    lengths = ends - starts
    at = np.flatnonzero(solid)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[x[at]] * powers[place], np.cumsum(lengths) - lengths)
    return starts, _mix(sums + lengths.astype(np.uint64))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z are lower-cased. A text of fewer words than a shingle has one, of all
    its words; without words it has none.
    """
    raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    buffer = b" ".join(raws)
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    starts, words = word_hashes(buffer)
    bounds = np.searchsorted(starts, begins)
    wide = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        wide = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            wide += words[k : k + n] * _PLACE[k]
        wide = _mix(wide)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(wide[a : b - WORDS + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    short += words[a + k] * _PLACE[k]
                short += np.uint64(b - a) * _PLACE[WORDS]
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
