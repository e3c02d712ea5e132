"""Ids of whole texts by a byte-level tokenizer, through a memory of text segments.

The tokenizer cuts a text into pieces before it merges bytes, and merges never cross a cut.  Some cuts can be seen
without its pattern, whatever stands around them:

* before a single space between two characters that are no white space,
* before and after a single line feed between two such characters,
* between an ASCII letter and an ASCII digit or mark.

Text between such cuts is a segment.  The library encodes each distinct segment once per worker process, and documents
are put together from the ids of their segments.  A text that holds an added token's string is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stridelake.llm import words as W

#: Segments a worker process remembers, and the bytes above which a segment is not remembered.
MEMORY, LONG_SEGMENT = 1_500_000, 40


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the segments of some documents; every document that has bytes starts one."""
    n = len(data)
    letter, mark, solid = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    mark[0x21:0x7F] = ~letter[0x21:0x7F]
    solid[:0x21] = False
    solid[0x7F] = False
    wide = np.zeros(256, bool)
    wide[[0xE1, 0xE2, 0xE3]] = True  # some of these characters, and of those that begin with C2, are white space
    starts = np.zeros(n + 1, bool)
    starts[1:n] = letter[data[:-1]] & mark[data[1:]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    for byte in (0x20, 0x0A):
        at = np.flatnonzero(data == byte)
        at = at[(at > 1) & (at < n - 1)]
        at = at[~edge[at] & ~edge[at + 1]]
        before, after = data[at - 1], data[at + 1]
        sure = solid[before] & solid[after] & ~wide[after] & (after != 0xC2)
        sure &= (before < 0x80) | ((data[at - 2] != 0xC2) & ~wide[data[at - 3]])
        starts[at[sure]] = True
        if byte == 0x0A:
            starts[at[sure] + 1] = True
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts[:n])


class _Memory:
    """Ids of segments by hash: sorted hashes, and where their ids lie."""

    def __init__(self):
        self.code, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, code, size, ids):
        at = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.code, code)
        self.code, self.at, self.size = np.insert(self.code, place, code), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """``(string column) -> one id array per text``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        # One per worker process: the library module lives as long as the process.
        encoders = vars(tokenizers).setdefault("_stridelake_encoders", {})
        if path not in encoders:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            model = json.loads(tokenizer.to_str())
            kind, before = model["model"]["type"], model["pre_tokenizer"] or {}
            if kind != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["normalizer"]:
                raise ValueError("only plain byte-level tokenizer files are supported")
            encoders[path] = (tokenizer, [t["content"] for t in model["added_tokens"]], _Memory())
        self.path, self.encoders = path, encoders
        self.tokenizer, self.added, self.memory = encoders[path]

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = W.text_bytes(column)
        for a, b in W.pieces(offsets, 8 << 20):
            yield from self._piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def _raw(self, data: np.ndarray, start: int, end: int) -> str:
        return data[start:end].tobytes().decode()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 5000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]
        return out

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        if not len(data):
            yield from [np.zeros(0, np.uint32)] * (len(offsets) - 1)
            return
        start = segment_starts(data, offsets)
        end = np.append(start[1:], len(data))
        # A segment never crosses a document: every document that has bytes starts one.
        code = W.segment_codes(data, start, end)
        distinct, first, place = np.unique(code, return_index=True, return_inverse=True)
        if len(self.memory.code) > MEMORY:
            self.memory = self.memory.__class__()
            self.encoders[self.path] = (self.tokenizer, self.added, self.memory)
        memory = self.memory
        at = np.searchsorted(memory.code, distinct)
        known = at < len(memory.code)
        known[known] = memory.code[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        made = self._encode([self._raw(data, start[i], end[i]) for i in first[new]])
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(sizes.sum()))
        short = (end - start)[first[new]] <= LONG_SEGMENT
        # Ids of this piece's distinct segments: what is remembered, then what is new.
        ids = np.concatenate([memory.ids, flat])
        from_, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        from_[known], size[known] = memory.at[at[known]], memory.size[at[known]]
        from_[new], size[new] = len(memory.ids) + np.cumsum(sizes) - sizes, sizes
        memory.add(distinct[new[short]], sizes[short], flat[np.repeat(short, sizes)])
        counts = size[place]
        total = np.cumsum(counts)
        everything = ids[np.repeat(from_[place] - (total - counts), counts) + np.arange(total[-1])]
        edges = np.append(0, total)[np.searchsorted(start, offsets)]
        plain = [t.encode() for t in self.added]
        raw = data.tobytes() if plain else b""
        special = [t for t in plain if t in raw]
        for i, j, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            if special and any(raw.find(t, i, j) >= 0 for t in special):
                yield np.array(self.tokenizer.encode(raw[i:j].decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield everything[x:y]
