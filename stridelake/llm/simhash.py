"""SimHash near duplicates by tables of distances to reference fingerprints.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of a text's word n-grams, repeats
included.  Texts link at ``RADIUS`` or fewer differing bits.

For any reference p, the distances of two fingerprints to p differ by no more than the fingerprints themselves, so a pair
with a larger coordinate difference is discarded unseen.  The references are a base, one neighbour of the base for each
bit, and some spread ones:

1. Equal fingerprints are one entry.
2. The distance to a neighbour less that to the base is 1 or -1, and a pair within the radius differs in at most RADIUS
   of these 64 relative distances.  They are dealt into RADIUS + 2 groups, so two groups or more agree in full: an entry
   goes to one bucket for each pair of groups, with the relative distances of both as the key.
3. Within a bucket entries are ordered by their distance to the first spread reference and compared with those that
   follow while that differs by RADIUS or less; pairs are discarded by the other spread references, and survivors are
   verified bit by bit.  A bucket yields a forest of its links, not its pairs.
4. A bucket of more than ``BUCKET`` entries is not compared: two fingerprints are within two bits if and only if they
   have a common neighbour within one bit, so its entries meet on their 65 neighbours, in groups of 65 at most.

Null texts, empty texts and texts without words have fingerprint zero, which links like any other.  Texts of fewer words
than ``n`` have their whole word sequence as the only n-gram.  Repeated rows are copies.  Rows without ``doc_id`` get a
fingerprint, take part in no group, and have a null ``component_id``.  Further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from stridelake.llm import words as W
from stridelake.llm.graph import components
from stridelake.llm.store import Kept, kept_table

#: Bits in which linked fingerprints differ at most.
RADIUS = 2
SEED = 42
#: Entries of a bucket that are compared with each other.
BUCKET = 2048
#: n-grams whose bits are counted at a time.
CHUNK = 1 << 15

_SPREAD = 16
_REFERENCES = W.mix(np.arange(1, _SPREAD + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE, SPREAD = _REFERENCES[0], _REFERENCES[1:]
NEIGHBOURS = BASE ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered words with one blank after each, their starts and ends, and the first word of each document (one entry more)."""
    data = W.lower_table()[data]
    inside = W.spaces_table()[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    size = size - start
    placed = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[np.flatnonzero(inside) + np.repeat(placed - start, size)] = data[inside]
    return out.tobytes(), placed, placed + size, first


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of the hashes' bits, bit by bit."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(column: pa.Array, n: int = 3) -> list[int]:
    """Fingerprints of texts, as signed 64-bit integers."""
    data, offsets = W.text_bytes(column)
    found, code, seed = [], xxhash.xxh64_intdigest, SEED
    for a, b in W.pieces(offsets):
        text, start, end, first = joined_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        start, end, first = start.tolist(), end.tolist(), first.tolist()
        for i, j in zip(first, first[1:]):
            last = max(i + 1, j - n + 1)  # one past the first word of the last n-gram
            spans = zip(start[i:last], end[min(i + n, j) - 1 : j]) if j > i else ()
            found.append(fingerprint(np.array([code(text[s:e], seed) for s, e in spans], "<u8")))
    return found


def bucket_keys(codes: np.ndarray) -> np.ndarray:
    """For each fingerprint, one key per pair of groups of neighbour references: rows x buckets."""
    base = np.bitwise_count(codes ^ BASE).astype(np.int16)
    nearer = np.zeros(len(codes), np.uint64)
    for bit, reference in enumerate(NEIGHBOURS):
        relative = np.bitwise_count(codes ^ reference).astype(np.int16) - base
        nearer |= (relative < 0).astype(np.uint64) << np.uint64(bit)
    groups = RADIUS + 2
    width = 64 // groups
    keys = []
    for k, pair in enumerate(combinations(range(groups), 2)):
        mask = sum(((1 << width) - 1) << (width * g) for g in pair)
        keys.append(W.mix((nearer & np.uint64(mask)) ^ W.mix(np.full(1, k + 1, np.uint64))))
    return np.stack(keys, 1) if len(codes) else np.zeros((0, groups * (groups - 1) // 2), np.uint64)


def coordinates(codes: np.ndarray) -> np.ndarray:
    """Distances to the spread references: rows x references."""
    return np.stack([np.bitwise_count(codes ^ r) for r in SPREAD], 1).astype(np.uint8)


class Forest:
    """Rows joined by links; ``root`` names the first row of each tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            x, y = np.minimum(x, y), np.maximum(x, y)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, y, x)
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def bucket_links(key: np.ndarray, code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Roots of rows that are sorted by key and first coordinate, where pairs of one key link within the radius."""
    forest = Forest(len(key))
    at = np.arange(len(key))
    first = table[:, 0].astype(np.int16)
    lag = 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[(key[at] == key[at + lag]) & (first[at + lag] - first[at] <= RADIUS)]
        if not len(at):
            return forest.root
        a = at
        for k in range(1, table.shape[1]):
            if not len(a):
                break
            a = a[np.abs(table[a, k].astype(np.int16) - table[a + lag, k]) <= RADIUS]
        a = a[np.bitwise_count(code[a] ^ code[a + lag]) <= RADIUS]
        forest.add(a, a + lag)


def _table(entries: DataFrame) -> DataFrame:
    """``key, code, distances``: a row for each entry and bucket."""

    def deal(batches):
        for batch in batches:
            codes = np.asarray(batch.column("code")).view(np.uint64)
            keys, table = bucket_keys(codes), coordinates(codes)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_SPREAD), len(codes), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())
            yield from (pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column("code"), rows], names=["key", "code", "distances"])
                        for k in np.ascontiguousarray(keys.T))

    return entries.mapInArrow(deal, "key long, code long, distances binary")


def _compared(dealt: DataFrame) -> DataFrame:
    """Links ``a, b`` within buckets; rows come by key, so a bucket ends where the next begins."""

    def compare(batches):
        held = None

        def links(rows):
            key, code = (np.asarray(rows.column(c)) for c in ("key", "code"))
            table = np.frombuffer(b"".join(rows.column("distances").to_pylist()), np.uint8).reshape(-1, _SPREAD)
            root = bucket_links(key, code.view(np.uint64), table)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(code[at]), pa.array(code[root[at]])], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            key = rows.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
            held = rows.slice(cut)
            if cut:
                yield links(rows.slice(0, cut))
        if held is not None:
            yield links(held)

    return dealt.repartition("key").sortWithinPartitions("key", F.substring("distances", 1, 1), "code").mapInArrow(compare, "a long, b long")


def _by_neighbours(entries: DataFrame) -> DataFrame:
    """Links ``a, b`` of entries that have a common neighbour: a star per neighbour, of 65 entries at most."""
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("code").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = entries.select("code", F.explode(F.concat(F.array("code"), near)).alias("neighbour"))
    stars = met.groupBy("neighbour").agg(F.min("code").alias("b"), F.collect_list("code").alias("codes")).where(F.size("codes") > 1)
    return stars.select(F.explode("codes").alias("a"), "b").where("a <> b")


def simhash_links(entries: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints (column ``code``) wherever two differ in ``RADIUS`` bits or fewer."""
    dealt = _table(entries)
    crowded = dealt.groupBy("key").count().where(F.col("count") > BUCKET).select("key")
    compared = _compared(dealt.join(crowded, "key", "left_anti"))
    apart = _by_neighbours(dealt.join(crowded, "key", "left_semi").select("code").distinct())
    return compared.union(apart).distinct()


def simhash_groups(docs: DataFrame, n: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links)."""

    def describe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), n), pa.int64())], names=["doc_id", "code"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = kept_table(chosen.mapInArrow(describe, "doc_id long, code long"), "fingerprints")
    least = Kept(described.where("doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("least")), "entries")
    linked = components(simhash_links(least.df.select("code")))
    rooted = least.df.join(linked.select(F.col("node").alias("code"), "root"), "code", "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = kept_table(rooted.join(of_root, "root").select("code", "component_id"), "groups")
    least.release()
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return described.join(of_code, "code", "left").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), component.alias("component_id"))
