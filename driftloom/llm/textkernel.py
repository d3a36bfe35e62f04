"""Words of UTF-8 texts as numpy arrays: a block of texts at a time, straight from Arrow buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; these bytes never occur inside a longer
UTF-8 character, so bytes give the same words as characters. Hashes are chains and trees of a mixing
step that isn't linear, so that no regular text (a polynomial of a Thue-Morse word, say) makes many of
them meet; long words are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000
#: Longest stretch of bytes hashed in numpy, eight at a time; longer ones go through BLAKE2.
CHAINED = 64
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order; for either one fixed it is a bijection of the other."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def stretch_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the ``length`` bytes at every ``start``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = length.astype(np.uint64) + np.uint64(seed << 32)
    place = np.arange(8)
    live = np.flatnonzero(length <= CHAINED)
    for done in range(0, CHAINED, 8):
        live = live[length[live] > done]
        if not len(live):
            break
        chunk = padded[start[live, None] + (done + place)]
        chunk[place >= (length[live] - done)[:, None]] = 0
        out[live] = join(out[live], chunk.view("<u8")[:, 0])
    for i in np.flatnonzero(length > CHAINED).tolist():
        own = data[start[i] : start[i] + length[i]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(own, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "<u8")[0]
    return mix(out)


class Texts:
    """A block of texts: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def one(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """First and last row (exclusive) of each block and its texts; nulls are empty, a long text is a block of its own."""
    held = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield at, to, Texts(data[own[0] : own[-1]], own - own[0])
        at = to


class Words:
    """Words of a block: first byte, byte after the last, and the first word of each text."""

    def __init__(self, texts: Texts):
        self.texts = texts
        data, offsets = texts.data, texts.offsets
        inside = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return stretch_hashes(self.texts.data, self.start, self.end - self.start)


    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words in turn with one blank after each, and where each begins (one more for the end)."""
        length = self.end - self.start + 1
        edge = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start - edge[:-1], length) + np.arange(int(edge[-1]))
        out = np.append(self.texts.data, np.uint8(32))[at]
        out[edge[1:] - 1] = 32
        return out.tobytes(), edge


def _tree(part: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive hashes: blocks of 1, 2, 4 … of them, joined from the left."""
    n = len(part) - size + 1
    out, covered, width = None, 0, 1
    while True:
        if size & width:
            own = part[covered : covered + n]
            out = own if out is None else join(out, own)
            covered += width
        if 2 * width > size - covered:
            return out
        part = join(part[:-width], part[width:])
        width *= 2


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive words; across texts too, which the caller leaves out."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    return mix(_tree(hashes ^ np.uint64(seed) if seed else hashes, size))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest, by the upper 32 bits, of each ``width`` consecutive hashes."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[step:], low[:-step])
        reach += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def byte_windows(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` (a multiple of 8) consecutive bytes; across texts too, which the caller leaves out."""
    if size % 8:
        raise ValueError("size must be a multiple of 8")
    if len(data) < size:
        return np.zeros(0, np.uint64)
    part = data.astype(np.uint64)
    for width in (1, 2, 4):
        part = part[:-width] | part[width:] << np.uint64(8 * width)
    if seed:
        part = part ^ np.uint64(seed)
    n, out, covered, width = len(data) - size + 1, None, 0, 8
    while True:
        if size & width:
            own = part[covered : covered + n]
            out = own if out is None else join(out, own)
            covered += width
        if 2 * width > size - covered:
            return mix(out)
        part = join(part[:-width], part[width:])
        width *= 2
