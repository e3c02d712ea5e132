"""Benchmark passages in documents: word windows of test items, found in all documents.

Words are runs of ASCII digits and letters (lowered) and of all characters beyond ASCII.  A window is ``size``
consecutive words of an item; an item of fewer words, but not none, is one window.  Every occurrence of a window is
verified against the window's own words, so equal hashes of different words never count.

The item windows are counted first.  Up to ``MAX_BROADCAST`` of them go to every task as a sorted hash array; beyond
that they are dealt into parts of that size.  Each part scans the documents on its own, writes the texts it hits and
releases its broadcast before the next; the hits are then united per text.

Null and empty texts, in documents or items, have no words and are never hit.  Repeated rows are judged alike.  Items
without an id count as the item ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame

from stridelake.llm import words as W
from stridelake.llm.store import kept_table

#: Item windows (a few hundred bytes each) that one broadcast holds at most.
MAX_BROADCAST = 500_000

_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
                       T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """``length, code, window, item``: the distinct word windows of ``item_id, text``."""

    def cut(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            ids = batch.column("item").to_pylist()
            found = W.split_words(data, offsets, W.alnum_table(), W.lower_table())
            rows = []
            for d, item in enumerate(ids):
                i, j = int(found.first[d]), int(found.first[d + 1])
                length = min(size, j - i)
                codes = W.window_codes(found.code[i:j], length) if length else ()
                rows += [(length, int(c), found.text(i + k, i + k + length), item) for k, c in enumerate(np.asarray(codes).astype(np.int64))]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["length", "code", "window", "item"])

    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string"))
    return chosen.mapInArrow(cut, "length int, code long, window binary, item string").distinct()


class _Index:
    """Item windows of each length: sorted hashes, and the words and items behind each hash."""

    def __init__(self, rows: list[tuple]):
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        grouped: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for length, code, window, item in rows:
            grouped.setdefault(length, {}).setdefault(code & 0xFFFFFFFFFFFFFFFF, {}).setdefault(bytes(window), []).append(item)
        for length, codes in grouped.items():
            self.by_length[length] = (np.sort(np.fromiter(codes, np.uint64)), codes)

    def hits(self, found: W.Words) -> list[tuple[np.ndarray, np.ndarray, set]]:
        """Starts and sizes of verified hits and their items, per document."""
        out = [([], [], set()) for _ in range(len(found.first) - 1)]
        for length, (sorted_codes, codes) in self.by_length.items():
            starts, document = W.window_documents(found.first, length)
            made = W.window_codes(found.code, length)[starts]
            at = np.minimum(np.searchsorted(sorted_codes, made), len(sorted_codes) - 1)
            for k in np.flatnonzero(sorted_codes[at] == made):
                i, d = int(starts[k]), int(document[k])
                items = codes[int(made[k])].get(found.text(i, i + length))
                if items is not None:
                    out[d][0].append(i - int(found.first[d]))
                    out[d][1].append(length)
                    out[d][2].update(items)
        return out


def _find(text: Column, rows_of) -> Column:
    @F.arrow_udf(_FOUND)
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _Index(rows_of())
        for column in columns:
            data, offsets = W.text_bytes(column)
            n_words, n_hit, starts, sizes, items = [], [], [], [], []
            for a, b in W.pieces(offsets):
                found = W.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.alnum_table(), W.lower_table())
                for d, (s, z, names) in enumerate(index.hits(found)):
                    n = int(found.first[d + 1] - found.first[d])
                    n_words.append(n)
                    n_hit.append(int(W.covered(np.array(s), np.array(z), n).sum()) if s else 0)
                    starts.append(s)
                    sizes.append(z)
                    items.append(sorted(names))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((n_words, n_hit, starts, sizes, items), kinds)], names=_FOUND.names)

    return find(text.cast("string"))


def with_hits(docs: DataFrame, items: DataFrame, column: str, size: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with a struct ``column``: n_words, n_hit (words inside an occurrence), starts and sizes of the
    occurrences (in words), and items (sorted ids of the items that occur).

    Documents are not shuffled but for items of more than ``max_broadcast`` windows, whose hits are joined by text.
    """
    windows = item_windows(items, size)
    n = windows.count()
    parts = max(1, -(-n // max_broadcast))
    spark = docs.sparkSession
    if parts == 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in windows.toLocalIterator()])
        return docs.withColumn(column, _find(F.col("text"), lambda: shared.value))
    hit = None
    for part in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("code"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.toLocalIterator()])
        found = docs.select(_text_key().alias("__key"), _find(F.col("text"), lambda shared=shared: shared.value).alias("found")).where("found.n_hit > 0")
        table = kept_table(found.select("__key", "found.starts", "found.sizes", "found.items").dropDuplicates(["__key"]), "hits")
        shared.destroy()
        hit = table if hit is None else hit.unionByName(table)
    starts, sizes = (F.flatten(F.collect_list(c)) for c in ("starts", "sizes"))
    united = hit.groupBy("__key").agg(starts.alias("__starts"), sizes.alias("__sizes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    placed = docs.withColumn("__key", _text_key()).join(united, "__key", "left")
    none = F.array()
    counted = F.struct(
        _word_count(F.col("text")).alias("n_words"), _union_size(F.coalesce("__starts", none.cast("array<long>")), F.coalesce("__sizes", none.cast("array<long>"))).alias("n_hit"),
        F.coalesce("__starts", none.cast("array<long>")).alias("starts"), F.coalesce("__sizes", none.cast("array<long>")).alias("sizes"),
        F.coalesce("__items", none.cast("array<string>")).alias("items"))
    return placed.withColumn(column, counted).drop("__key", "__starts", "__sizes", "__items")


def _text_key() -> Column:
    """Hits depend on the text alone, so equal texts share them."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def _word_count(text: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def count(column: pa.Array) -> pa.Array:
        data, offsets = W.text_bytes(column)
        found = W.split_words(data, offsets, W.alnum_table(), W.lower_table())
        return pa.array(np.diff(found.first).astype(np.int64))

    return count(text.cast("string"))


@F.arrow_udf(T.LongType())
def _union_size(starts: pa.Array, sizes: pa.Array) -> pa.Array:
    def union(s: np.ndarray, z: np.ndarray) -> int:
        return int(W.covered(s, z, int((s + z).max())).sum()) if len(s) else 0

    return pa.array([union(np.array(s, np.int64), np.array(z, np.int64)) for s, z in zip(starts.to_pylist(), sizes.to_pylist())], pa.int64())


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted item ids), contaminated."""
    found = with_hits(docs.select("doc_id", "text"), items, "__found", size, max_broadcast)
    hit = F.col("__found")
    return found.select("doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"), (hit["n_hit"] > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, size: int = 10, least_hit: int = 1) -> DataFrame:
    """``docs`` without those of which ``least_hit`` or more words lie in benchmark windows; all columns stay."""
    return with_hits(docs, items, "__found", size).where(F.col("__found")["n_hit"] < least_hit).drop("__found")


@F.arrow_udf(T.StringType())
def _cut_spans(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for one, s, z in zip(text, starts.to_pylist(), sizes.to_pylist()):
        raw = one.as_py()
        if raw is None or not s:
            out.append(raw)
            continue
        encoded = np.frombuffer(raw.encode(), np.uint8)
        found = W.split_words(encoded, np.array([0, len(encoded)]), W.alnum_table(), W.lower_table())
        hit = W.covered(np.array(s), np.array(z), len(found.start))
        cut = np.zeros(len(encoded), bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for i, j in zip(edges[::2], edges[1::2]):
            cut[found.start[i] : found.end[j - 1]] = True
        out.append(encoded[~cut].tobytes().decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with the hit words, and what stands between neighbouring ones, cut from ``text``."""
    found = with_hits(docs, items, "__found", size)
    return found.withColumn("text", _cut_spans("text", F.col("__found")["starts"], F.col("__found")["sizes"])).drop("__found")

