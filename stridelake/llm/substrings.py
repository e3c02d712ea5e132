"""Word windows that repeat across documents, found by level-wise doubling.

A window of ``window`` words is judged over lengths that double up to it (13: 7, then 13).  At a length below the last,
a window stands or falls with one of its sub-windows of that length, the one of the smallest hash, so equal windows
look at equal places and only about two in ``window - length + 2`` places of a text are sent.  Windows whose sub-window
occurs in one document alone are dropped; only the others are extended to twice the length, until none is left or the
full length is reached.  At the full length an occurrence is a repeat if the same words start in a document with a
smaller id.

What is shuffled are hashes in packed arrays, one row per block of text and part of the hash space.  Within a block,
equal windows are settled at once and only the smallest document's goes on, so a passage that a third of all documents
share costs one entry per block.  Texts are shuffled once, those with surviving windows once more.

Null and empty texts have no words.  Documents with fewer words than ``window`` lose none.  Rows without ``doc_id`` are
compared with nothing and keep all words; repeated rows (equal ids) do not count as smaller than each other.  Hashes
of the full length have 64 bits and the part they are dealt to; equal hashes of different words are not told apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stridelake.llm import words as W
from stridelake.llm.store import bytes_of, kept_table

#: Bytes of text whose windows are settled together, and bytes of text per part of the hash space.
BLOCK_BYTES, PART_BYTES = 8 << 20, 96 << 20

_PACKED = "part int, settled boolean, keys binary, docs binary, counts binary, codes binary, places binary"
_FLAGS = "key long, places binary"


def doubling(window: int) -> list[int]:
    """Lengths that end at ``window``, each at most twice the one before."""
    lengths = [window]
    while lengths[0] > 8:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def anchors(code: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window start, the start of its sub-window of ``length`` words with the smallest hash (the first of equals)."""
    inner = W.window_codes(code, length)
    k = window - length + 1
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = inner[:n].copy(), np.zeros(n, np.int64)
    for step in range(1, k):
        other = inner[step : step + n]
        less = other < best
        best[less] = other[less]
        at[less] = step
    return np.arange(n) + at


def _places(code: np.ndarray, length: int, window: int, alive: np.ndarray | None) -> np.ndarray:
    """Starts of the sub-windows to compare at this length, for one document."""
    at = anchors(code, length, window)
    return np.unique(at if alive is None else at[alive[: len(at)]])


def _unpack_alive(flags: bytes | None, n: int) -> np.ndarray | None:
    return None if flags is None else np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)


def _blocks(batch: pa.RecordBatch):
    """Runs of rows of a batch in ascending doc_id, with their words."""
    batch = pa.Table.from_batches([batch]).sort_by("doc_id").combine_chunks()
    data, offsets = W.text_bytes(batch.column("text"))
    for a, b in W.pieces(offsets, BLOCK_BYTES):
        yield batch.slice(a, b - a), W.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.spaces_table())


def _send(docs: DataFrame, length: int, window: int, parts: int) -> DataFrame:
    last = length == window
    width = 8 if last else 5  # bytes of a hash; before the last length a chance agreement only costs a comparison

    def pack(part, settled, keys, docs_, rows, codes, places):
        """Entries, sorted by row, as one packed row."""
        edges = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        counts = np.diff(np.append(edges, len(rows))).astype("<u4")
        raw = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if not settled else b""
        owners = rows[edges]
        return (part, settled, keys[owners].tobytes(), docs_[owners].tobytes() if last and not settled else b"", counts.tobytes(), raw, places.astype("<u4").tobytes())

    def send(batches):
        for batch in batches:
            for rows, found in _blocks(batch):
                keys, docs_ = (np.asarray(rows.column(c).to_numpy(), np.int64) for c in ("key", "doc_id"))
                flags = rows.column("alive").to_pylist()
                hashes = W.window_codes(found.code, length)
                owner, place, code = [], [], []
                for d, (i, j) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                    if j - i >= window:
                        at = _places(found.code[i:j], length, window, _unpack_alive(flags[d], j - i - window + 1))
                        _, first = np.unique(hashes[i + at], return_index=True)  # once per document
                        first.sort()
                        owner.append(np.full(len(first), d))
                        place.append(at[first])
                        code.append(hashes[i + at[first]])
                if not owner:
                    continue
                owner, place, code = np.concatenate(owner), np.concatenate(place), np.concatenate(code)
                order = np.argsort(code, kind="stable")
                fresh = np.append(True, code[order][1:] != code[order][:-1])
                group = np.cumsum(fresh) - 1
                edges = np.flatnonzero(fresh)
                ranked = docs_[owner[order]]
                smallest = ranked[edges][group]
                largest = ranked[np.append(edges[1:], len(order)) - 1][group]
                known = ranked > smallest if last else largest > smallest
                out = []
                for chosen, settled in ((np.sort(order[known]), True), (np.sort(order[ranked == smallest]), False)):
                    if settled:
                        if len(chosen):
                            # A key is a hash: blocks of all tasks spread over all parts.
                            spread = int(keys[owner[chosen[0]]] % parts)
                            out.append(pack(spread, True, keys, docs_, owner[chosen], None, place[chosen]))
                        continue
                    part = (code[chosen] >> np.uint64(40)) % np.uint64(parts)
                    by_part = np.argsort(part, kind="stable")
                    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(bounds)):
                        one = chosen[by_part[bounds[p] : bounds[p + 1]]]
                        out.append(pack(int(p), False, keys, docs_, owner[one], code[one], place[one]))
                if out:
                    columns = list(zip(*out))
                    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])

    return docs.mapInArrow(send, _PACKED)


def _settle(packed: DataFrame, last: bool, width: int) -> DataFrame:
    """Flags of one part of the hash space: which entries repeat."""

    def settle(table: pa.Table) -> pa.Table:
        entries = [len(places) // 4 for places in bytes_of(table["places"])]
        n, done = sum(entries), np.repeat(table["settled"].to_numpy(), entries)
        key, place, code = np.empty(n, np.int64), np.empty(n, np.uint32), np.zeros((n, 8), np.uint8)
        doc = np.empty(n, np.int64) if last else key
        at = 0
        for counts, keys, docs_, codes, places, size in zip(*(bytes_of(table[c]) for c in ("counts", "keys", "docs", "codes", "places")), entries):
            runs, to = np.frombuffer(counts, "<u4"), at + size
            key[at:to] = np.repeat(np.frombuffer(keys, np.int64), runs)
            place[at:to] = np.frombuffer(places, "<u4")
            if codes:
                code[at:to, :width] = np.frombuffer(codes, np.uint8).reshape(-1, width)
                if last:
                    doc[at:to] = np.repeat(np.frombuffer(docs_, np.int64), runs)
            at = to
        code, flag = code.view("<u8").ravel(), done.copy()
        slice_of = (code & np.uint64(7)).astype(np.uint8)
        for k in range(8):  # a share of the hashes at a time bounds what sorting needs
            chosen = np.flatnonzero((slice_of == k) & ~done)
            if not len(chosen):
                continue
            chosen = chosen[np.argsort(code[chosen], kind="stable")]
            edges = np.flatnonzero(np.append(True, np.diff(code[chosen]) != 0))
            ranked, runs = doc[chosen], np.diff(np.append(edges, len(chosen)))
            smallest = np.repeat(np.minimum.reduceat(ranked, edges), runs)
            other = ranked if last else np.repeat(np.maximum.reduceat(ranked, edges), runs)
            flag[chosen] = other > smallest
        key, place = key[flag], place[flag]
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(key)) if len(key) else edges
        return pa.table({"key": pa.array(key[edges]), "places": pa.array([place[i:j].tobytes() for i, j in zip(edges, ends)], pa.binary())})

    return packed.groupBy("part").applyInArrow(settle, _FLAGS).groupBy("key").agg(F.collect_list("places").alias("flags"))


def _flagged(code: np.ndarray, length: int, flags: list[bytes] | None) -> np.ndarray:
    """True for each place whose sub-window of ``length`` words is one of the flagged ones (which name one place of each)."""
    hashes = W.window_codes(code, length)
    if not flags or not len(hashes):
        return np.zeros(len(hashes), bool)
    return np.isin(hashes, hashes[np.frombuffer(b"".join(flags), "<u4")])


def repeats(docs: DataFrame, window: int = 13, digest: bool = False) -> DataFrame:
    """Per row of ``doc_id, text``: doc_id, n_words, n_removed, and the words that stay, joined by one space.

    A word goes if it lies in a window whose words also start in a document with a smaller id; windows are those of the
    input.  The last column is ``kept`` or, with ``digest``, ``kept_sha256``.
    """
    lengths = doubling(window)
    result = "kept_sha256" if digest else "kept"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = chosen.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    size = chosen.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    schema = f"doc_id long, key long, n_words long, n_removed long, {result} string, text string, alive binary"
    names = [c.split()[0] for c in schema.split(", ")]
    live, finished = chosen.withColumn("alive", F.lit(None).cast("binary")), None

    def advance(length):
        last = length == window

        def apply(batches):
            for batch in batches:
                data, offsets = W.text_bytes(batch.column("text"))
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
                texts, all_flags, before = batch.column("text"), batch.column("flags"), batch.column("alive").to_pylist()
                out, row = [], 0
                for a, b in W.pieces(offsets):
                    found = W.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.spaces_table())
                    for i, j in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                        flags, code = all_flags[row].as_py(), found.code[i:j]
                        flagged = _flagged(code, length, flags) if flags else None
                        if last or flagged is None:
                            gone = W.covered(np.flatnonzero(flagged), window, j - i) if last and flagged is not None else np.zeros(j - i, bool)
                            words_ = [found.data[s:e].tobytes() for s, e in zip(found.start[i:j][~gone], found.end[i:j][~gone])] if gone.any() else None
                            kept = b" ".join(words_) if words_ is not None else b" ".join((texts[row].as_py() or "").encode().split())
                            made = hashlib.sha256(kept).hexdigest() if digest else kept.decode()
                            out.append((ids[row], keys[row], j - i, int(gone.sum()), made, None, None))
                        else:
                            alive = flagged[anchors(code, length, window)]
                            if before[row] is not None:
                                alive &= _unpack_alive(before[row], len(alive))
                            out.append((ids[row], keys[row], None, None, None, texts[row].as_py(), np.packbits(alive).tobytes()))
                        row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        return apply

    for length in lengths:
        flags = _settle(_send(live.where("key is not null"), length, window, parts), length == window, 8 if length == window else 5)
        joined = live.select("doc_id", "key", "text", "alive").join(flags, "key", "left")
        stage = joined.mapInArrow(advance(length), schema)
        if length != window:
            stage = kept_table(stage, "windows")
            live = stage.where("text is not null").select("doc_id", "text", "key", "alive")
        ended = stage.where(F.col(result).isNotNull()).select("doc_id", "n_words", "n_removed", result)
        finished = ended if finished is None else finished.unionByName(ended)
    return finished
