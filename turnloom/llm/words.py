"""Word hashes of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .encoder import BLANK, P, P_INVERSE

#: Bytes of text handled at once; a longer text is handled by itself.
LIMIT = 1 << 20
_VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((P, P_INVERSE)):
            t = np.full(n, p, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(texts: list[str | None], limit: int = LIMIT) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about limit bytes in UTF-8, each with the index of its first text."""
    part, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if part and size + len(raw) > limit:
            yield first, part
            part, first, size = [], i, 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield first, part


def spans(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a blank behind each text, starts and ends of words, and the bounds of each text's words."""
    buf = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    ink = ~BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    stops = np.cumsum([len(r) + 1 for r in raws])
    return buf, starts, ends, np.concatenate([[0], np.searchsorted(starts, stops)])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, mixed."""
    powers, inverses = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * powers[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: sorted distinct hashes of shingles of width words, and the bounds of each text's set.

    A text of fewer words has all of them as its only shingle; a text without words has none.
    """
    for _, raws in groups(texts):
        buf, starts, ends, bounds = spans([r.lower() for r in raws])
        h = word_hashes(buf, starts, ends)
        n = np.diff(bounds)
        # runs[k - 1] has the hash of the k words from each word on
        runs = [h]
        for k in range(1, width):
            runs.append(mix(h[:-k] * np.uint64(3) + mix(runs[-1][1:] + np.uint64(1))) if len(h) > k else np.zeros(0, np.uint64))
        sets = []
        for a, k in zip(bounds[:-1].tolist(), n.tolist(), strict=True):
            sets.append(np.unique(runs[-1][a : a + k - width + 1]) if k >= width else runs[k - 1][a : a + 1] if k else h[:0])
        yield (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
