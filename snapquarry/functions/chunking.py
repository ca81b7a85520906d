"""Content-defined chunking, vectorised, and the codec of packs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChunkSizes:
    least: int = 16 * 1024
    average: int = 64 * 1024
    most: int = 256 * 1024

    def or_default(self) -> ChunkSizes:
        return self if min(self.least, self.average, self.most) > 0 else ChunkSizes()


#: A boundary needs so many low bits of the rolling hash to be zero, before and after the average size.
_STRICT_BITS, _LAX_BITS = 18, 14


def gear_table() -> np.ndarray:
    """256 numbers of a splitmix64 stream that starts one step after its increment."""
    step = 0x9E3779B97F4A7C15
    x = (np.arange(2, 258, dtype=np.uint64)) * np.uint64(step)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = (gear_table() & np.uint64((1 << _STRICT_BITS) - 1)).astype(np.uint32)


def cut_point(window: np.ndarray, sizes: ChunkSizes) -> int:
    """Where the first chunk of ``window`` ends.

    A bit of the rolling hash depends on as many bytes as its place tells, so the 18 low
    bits are a sum over the last 18 bytes, for all places at once.
    """
    n = min(len(window), sizes.most)
    if len(window) <= sizes.least:
        return len(window)
    values = _LOW[window[sizes.least : n]]
    rolling = np.zeros(len(values), np.uint32)
    for k in range(min(_STRICT_BITS, len(values))):
        rolling[k:] += values[: len(values) - k] << np.uint32(k)
    middle = max(0, min(sizes.average, n) - sizes.least)
    strict = np.flatnonzero(rolling[:middle] & np.uint32((1 << _STRICT_BITS) - 1) == 0)
    if len(strict):
        return sizes.least + int(strict[0])
    lax = np.flatnonzero(rolling[middle:] & np.uint32((1 << _LAX_BITS) - 1) == 0)
    return sizes.least + middle + int(lax[0]) if len(lax) else n


def split(read, sizes: ChunkSizes = ChunkSizes()) -> Iterator[bytes]:  # noqa: B008
    """Chunks of what ``read(n)`` returns until it is empty; at most two windows are in memory."""
    sizes, held, open_ = sizes.or_default(), b"", True
    while True:
        while open_ and len(held) < sizes.most:
            more = read(sizes.most)
            open_ = bool(more)
            held += more
        if not held:
            return
        cut = cut_point(np.frombuffer(held, np.uint8), sizes)
        yield held[:cut]
        held = held[cut:]


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, wbits=-15)
