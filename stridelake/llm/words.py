"""Words, word hashes and window hashes of Arrow text batches, in numpy.

A batch is handled as one byte array with document offsets, so a step costs a few
array operations per batch and not a Python call per word.  Hashes are 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 48
#: Bytes of text whose words are in memory at a time (a longer document is one piece).
PIECE_BYTES = 4 << 20


class Words(NamedTuple):
    """Words of some documents: byte ranges, hashes, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray  # documents + 1 entries

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def spaces_table() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (capital letters are lowered before)."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes, a longer document alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def segment_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    length = end - start
    code = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    active = np.flatnonzero(length <= LONG_WORD)
    k = 0
    while len(active):
        code[active] = (code[active] ^ data[start[active] + k]) * np.uint64(0x100000001B3)
        k += 1
        active = active[length[active] > k]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        code[i] = int.from_bytes(digest, "little")
    return mix(code)


def split_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: np.ndarray | None = None) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``."""
    if lower is not None:
        data = lower[data]
    inside = word_byte[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, segment_codes(data, start, end), np.searchsorted(start, offsets))


def window_codes(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by doubling: a window of 2k words is a pair of windows of k words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, total, power, width = None, 0, code, 1
    rest = size
    while rest:
        if rest & 1:
            done = power if done is None else pair(done[: len(code) - total - width + 1], power[total : len(code) - width + 1])
            total += width
        rest >>= 1
        if rest:
            power = pair(power[:-width], power[width:])
            width *= 2
    return done[:n]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def window_documents(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one document, and the documents they lie in."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    document = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - ahead[document] + first[document], document


def covered(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """True for each of ``n`` positions inside some range ``start .. start + size - 1``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + sizes, n), -1)
    return np.cumsum(steps[:-1]) > 0
