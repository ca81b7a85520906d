"""Hashes of word shingles, over whole texts, without a Python object for each word.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
lower case.  A shingle is five words in a row; a text of one to four words is one shingle;
a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_TURNS = _mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, _SLICE + 1), _powers(_Q, _SLICE + 1)


def _hash_words(folded: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of bytes in which 0 separates words."""
    inside = np.concatenate([[False], folded != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[folded] * up[: len(folded)], dtype=np.uint64)])
    return starts, _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of UTF-8 bytes, in slices that end between words."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    starts, hashes, at = [], [], 0
    while at < len(folded):
        end = min(at + _SLICE, len(folded))
        up, down = _UP, _DOWN
        if end < len(folded):
            gap = np.flatnonzero(folded[at:end] == 0)
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # one word longer than a slice
                gap = np.flatnonzero(folded[end:] == 0)
                end = end + int(gap[0]) if len(gap) else len(folded)
                up, down = _powers(_P, end - at + 1), _powers(_Q, end - at + 1)
        s, h = _hash_words(folded[at:end], up, down)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts, words = word_hashes(b"\n".join(raw))
    firsts = np.cumsum([0] + [len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, firsts).tolist()
    n = len(words) - WIDTH + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for k in range(WIDTH):
        joined += words[k : k + len(joined)] * _TURNS[k]
    joined = _mixed(joined)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WIDTH:
            out.append(np.unique(joined[a : b - WIDTH + 1]))
        elif b > a:
            out.append(_mixed(((words[a:b] * _TURNS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))[None]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """Rows from, to, and their texts, in slices of about ``limit`` bytes and at least one row."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, end, texts.slice(at, end - at).to_pylist()
        at = end


class MinHash:
    """``n`` hash functions on shingles that are hashes already."""

    def __init__(self, n: int, seed: int = 3):
        self.turns = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.turns), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(shingles), 1024):
            np.minimum(best, (shingles[a : a + 1024, None] * self.turns).min(axis=0), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)
