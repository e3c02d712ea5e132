"""Ranked lexical search: items visit the owners of their terms one after the other.

The index is cut by documents into shards and by terms into owners.  Terms are owned by how common they are: the first
owner has the rarest ones, and owners hold about equally many postings.  A bundle of items carries, for one shard, the
sparse accumulators of its items: documents and their scores so far.  In each stage the bundles of a shard meet the
postings of the next owner by cogroup, the owner adds the integer contributions of its terms, and the bundles go on.
After the last owner each bundle yields the best documents of its shard, and the best of those are the result.

An accumulator is carried on unless it cannot end among the best: some ``top`` documents of the shard have a higher score
already than it would have with the largest contributions of all owners to come.  That is exact, equal scores included.

Texts are read once: the postings of the items' terms are written to the shared folder, and counts of documents and
terms come from there.  A hash finds a word among the items' terms, and its bytes decide.

Null texts and texts without terms are no documents.  Rows of equal ``item_id`` and text are one item; one ``item_id``
with several texts is several items, each with its own ranks.  Items without terms return nothing.  Repeated documents
are documents of their own; one without ``doc_id`` counts and can be found, after those of equal score that have one.
Items are searched in groups of about ``MOST_ENTRIES`` distinct terms, a reading of the documents each; only a group's
terms are on the driver and in the tasks.  Further columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from stridelake.llm import words as W
from stridelake.llm.store import Kept

#: Documents of a shard and its postings (about), and items of a bundle: what one cogroup holds.
SHARD_DOCUMENTS, SHARD_POSTINGS, BUNDLE_ITEMS = 1 << 14, 1 << 22, 256
#: Distinct terms, added up over items, of a group of items, and its items.
MOST_ENTRIES, MOST_ITEMS = 250_000, 4096
#: Owners, that is stages.
OWNERS = 4


class Terms(NamedTuple):
    """Distinct terms of a group of items, sorted by hash, to be found in texts."""

    code: np.ndarray
    number: np.ndarray  # of the term with this hash
    term: list[bytes]  # by number
    size: np.ndarray  # by number, as the next two: length, first and last eight bytes
    head: np.ndarray
    tail: np.ndarray
    index: dict[bytes, int]

    @classmethod
    def of(cls, terms: list[bytes]) -> Terms:
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        start = np.append(0, end[:-1])[: len(terms)]
        code, number = np.unique(W.segment_codes(data, start, end), return_index=True)
        return cls(code, number, terms, end - start, *_ends(data, start, end), {t: i for i, t in enumerate(terms)})

    def find(self, words: W.Words) -> np.ndarray:
        """The number of each word's term, or -1."""
        found = np.full(len(words.code), -1, np.int64)
        if not len(self.code):
            return found
        place = np.minimum(np.searchsorted(self.code, words.code), len(self.code) - 1)
        at = np.flatnonzero(self.code[place] == words.code)
        number = self.number[place[at]]
        start, end = words.start[at], words.end[at]
        head, tail = _ends(words.data, start, end)
        same = (end - start == self.size[number]) & (head == self.head[number]) & (tail == self.tail[number])
        # Eight bytes from each end are all of a short word; longer ones, and those the hash misled, are looked up.
        for i in np.flatnonzero(~same | (end - start > 16)):
            number[i] = self.index.get(words.data[start[i] : end[i]].tobytes(), -1)
        found[at] = number
        return found


class Items(NamedTuple):
    """Items' terms: those of item i are ``number[first[i]:first[i + 1]]``, each ``count`` times."""

    first: np.ndarray
    number: np.ndarray
    count: np.ndarray

    @property
    def bundles(self) -> int:
        return -(-(len(self.first) - 1) // BUNDLE_ITEMS)


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of byte ranges, cut to their length."""
    around = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(around[:8].view("<u8"), (len(around) - 7,), (1,))
    outside = np.uint64(8) * (np.uint64(8) - np.minimum(end - start, 8).astype(np.uint64))
    return (eight[start + 8] << outside) >> outside, eight[end] >> outside


def split_terms(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Terms of texts: runs of ASCII letters and digits, and of bytes beyond ASCII; A-Z are lowered."""
    return W.split_words(data, offsets, W.alnum_table(), W.lower_table())


def item_entries(items: DataFrame) -> DataFrame:
    """``item, item_id, term, count``: a row for each distinct term of each distinct item; ``item`` tells items apart."""

    def entries(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            words = split_terms(data, offsets)
            rows, terms, counts = [], [], []
            for k, (i, j) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                found: dict[bytes, int] = {}
                for s, e in zip(words.start[i:j].tolist(), words.end[i:j].tolist()):
                    term = words.data[s:e].tobytes()
                    found[term] = found.get(term, 0) + 1
                rows += [k] * len(found)
                terms += found
                counts += found.values()
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("item", "item_id")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["item", "item_id", "term", "count"])

    chosen = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    numbered = chosen.select(F.sha2(F.to_json(F.struct("item_id", "text")), 256).alias("item"), "item_id", "text")
    return numbered.mapInArrow(entries, f"item string, item_id {items.schema['item_id'].dataType.simpleString()}, term binary, count long")


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """A row per shard: documents with any term and how many terms they have, ids and sizes of those with one of ``terms``,
    and their postings (term, document in the shard, occurrences) by term.  Shards follow the partitions of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(terms))

    def index(batches):
        terms = Terms(*sent.value)
        task, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def shard():
            ids, known, sizes, term, document, times = (np.concatenate(x) for x in zip(*(h[2:] for h in held)))
            before = np.cumsum([0] + [len(h[2]) for h in held])
            document = document + np.repeat(before[:-1], [len(h[5]) for h in held])
            order = np.argsort(term, kind="stable")
            columns = (ids.astype("<i8"), known.astype("u1"), sizes.astype("<i8"), term[order].astype("<i4"), document[order].astype("<u2"), times[order].astype("<i4"))
            numbers = ((task << 32) + count, sum(h[0] for h in held), sum(h[1] for h in held), len(ids))
            arrays = [pa.array([x], pa.int64()) for x in numbers] + [pa.array([c.tobytes()], pa.binary()) for c in columns]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "documents", "terms", "size", "ids", "known", "lengths", "term", "document", "times"])

        for batch in batches:
            ids = batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), np.asarray(ids.fill_null(0))
            data, offsets = W.text_bytes(batch.column("text"))
            for a, b in W.pieces(offsets):
                for low in range(a, b, SHARD_DOCUMENTS):
                    high = min(b, low + SHARD_DOCUMENTS)
                    words = split_terms(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    lengths = np.diff(words.first)
                    number = terms.find(words)
                    at = np.flatnonzero(number >= 0)
                    owner = np.searchsorted(words.first, at, "right") - 1
                    pairs, times = np.unique(owner * len(terms.term) + number[at], return_counts=True)
                    owner, term = np.divmod(pairs, max(len(terms.term), 1))
                    used, document = np.unique(owner, return_inverse=True)
                    if held and (sum(len(h[2]) for h in held) + len(used) > SHARD_DOCUMENTS or sum(len(h[5]) for h in held) + len(term) > SHARD_POSTINGS):
                        yield shard()
                        count += 1
                    held.append((int((lengths > 0).sum()), int(lengths.sum()), ids[low:high][used], known[low:high][used], lengths[used], term, document, times))
        if held:
            yield shard()

    schema = "shard long, documents long, terms long, size long, ids binary, known binary, lengths binary, term binary, document binary, times binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, schema)


def _term_counts(index: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each term, and the most occurrences in one; a row per task and term, added up in Spark."""

    def count(batches):
        held, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for term, times in zip(batch.column(0), batch.column(1)):
                term = np.frombuffer(term.as_buffer(), "<i4")
                held += np.bincount(term, minlength=size)
                np.maximum.at(most, term, np.frombuffer(times.as_buffer(), "<i4"))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at]), pa.array(most[at])], names=["term", "held", "most"])

    held, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    found = index.select("term", "times").mapInArrow(count, "term int, held long, most long").groupBy("term").agg(F.sum("held"), F.max("most"))
    for term, n, times in found.collect():
        held[term], most[term] = n, times
    return held, most


class Scoring(NamedTuple):
    """Whole-number scores: a term adds its weight times ``share`` of its occurrences and the document's size."""

    documents: int
    terms: int

    def weight(self, held: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * held + 1)))

    def size_factor(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and 25 * int(lengths.max()) * self.documents >= 1 << 63:
            return np.array([75 + 25 * n * self.documents // self.terms for n in lengths.tolist()], np.int64)
        return 75 + 25 * lengths * self.documents // self.terms

    @staticmethod
    def share(times: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * times // (1000 * times + 12 * factor)


def owners_of(held: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: from rare to common, about equally many postings each."""
    order = np.argsort(held, kind="stable")
    before = np.cumsum(held[order]) - held[order]
    owner = np.zeros(len(held), np.int64)
    owner[order] = np.minimum(before * owners // max(int(held.sum()), 1), owners - 1)
    return owner


def best(scores: np.ndarray, top: int) -> np.int64:
    """The ``top``-th largest score, or 0 where there are fewer."""
    found = scores[scores > 0]
    return np.partition(found, len(found) - top)[len(found) - top] if len(found) >= top else np.int64(0)


def unpacked_plan(plan) -> tuple[Items, np.ndarray, np.ndarray, np.ndarray, Scoring]:
    items, owner, weight, largest, scoring = plan.value
    return Items(*items), owner, weight, largest, Scoring(*scoring)


def _stage(bundles: DataFrame, index: DataFrame, stage: int, plan, top: int) -> DataFrame:
    """Bundles ``shard, bundle, starts, documents, scores`` after the owner ``stage``; after the last one ``item, doc_id, score``."""
    last = stage == OWNERS - 1
    last_columns = ["ids", "known"] if last else []

    def owned(batches):
        items, owner, weight, largest, scoring = unpacked_plan(plan)
        for batch in batches:
            for row in batch.to_pylist():
                term, document, times = (np.frombuffer(row[c], kind) for c, kind in (("term", "<i4"), ("document", "<u2"), ("times", "<i4")))
                at = owner[term] == stage
                factor = scoring.size_factor(np.frombuffer(row["lengths"], "<i8"))
                share = scoring.share(times[at].astype(np.int64), factor[document[at]])
                columns = [row["shard"], row["size"], term[at].tobytes(), document[at].tobytes(), share.astype("<i4").tobytes(), *(row[c] for c in last_columns)]
                kinds = [pa.int64()] * 2 + [pa.binary()] * 5
                for k in range(items.bundles):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())] + [pa.array([c], kind) for c, kind in zip(columns, kinds)],
                                                     names=["bundle", "shard", "size", "term", "document", "share", *last_columns])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        items, owner, weight, largest, _ = unpacked_plan(plan)
        carried, lists = left.to_pylist()[0], right.to_pylist()[0]
        begin = carried["bundle"] * BUNDLE_ITEMS
        own = range(begin, min(begin + BUNDLE_ITEMS, len(items.first) - 1))
        term, document = np.frombuffer(lists["term"], "<i4"), np.frombuffer(lists["document"], "<u2")
        share = np.frombuffer(lists["share"], "<i4").astype(np.int64)
        edge = np.searchsorted(term, np.arange(len(owner) + 1))
        starts, before, so_far = (np.frombuffer(carried[c], kind) for c, kind in (("starts", "<i8"), ("documents", "<u2"), ("scores", "<i8")))
        out = []
        for k, item in enumerate(own):
            scores = np.zeros(lists["size"], np.int64)
            if len(starts):
                scores[before[starts[k] : starts[k + 1]]] = so_far[starts[k] : starts[k + 1]]
            ahead = 0
            for x in range(items.first[item], items.first[item + 1]):
                t, weigh = items.number[x], items.count[x] * weight[items.number[x]]
                if owner[t] == stage:
                    found = slice(edge[t], edge[t + 1])
                    scores[document[found]] += weigh * share[found]
                elif owner[t] > stage:
                    ahead += weigh * largest[t]
            at = np.flatnonzero(scores >= max(best(scores, top) - ahead, 1))
            out.append((item, at, scores[at]))
        if not last:
            sizes = np.cumsum([0] + [len(at) for _, at, _ in out]).astype("<i8")
            rows = [sizes, np.concatenate([at for _, at, _ in out]).astype("<u2"), np.concatenate([s for *_, s in out]).astype("<i8")]
            return pa.table({"shard": pa.array([carried["shard"]], pa.int64()), "bundle": pa.array([carried["bundle"]], pa.int32()),
                             **{c: pa.array([r.tobytes()], pa.binary()) for c, r in zip(("starts", "documents", "scores"), rows)}})
        ids, known = np.frombuffer(lists["ids"], "<i8"), np.frombuffer(lists["known"], "u1") > 0
        found = []
        for item, at, scores in out:
            order = np.lexsort((ids[at], ~known[at], -scores))[:top]
            found.append((np.full(len(order), item), ids[at[order]], ~known[at[order]], scores[order]))
        item, doc_id, unknown, scores = (np.concatenate(x) for x in zip(*found))
        return pa.table({"number": pa.array(item, pa.int32()), "doc_id": pa.array(doc_id, pa.int64(), mask=unknown), "score": pa.array(scores, pa.int64())})

    kinds = "bundle int, shard long, size long, term binary, document binary, share binary" + ", ids binary, known binary" * last
    lists = index.select("shard", "size", "lengths", "term", "document", "times", *last_columns).mapInArrow(owned, kinds)
    schema = "number int, doc_id long, score long" if last else "shard long, bundle int, starts binary, documents binary, scores binary"
    return bundles.groupBy("shard", "bundle").cogroup(lists.groupBy("shard", "bundle")).applyInArrow(add, schema)


def _searched(spark: SparkSession, docs: DataFrame, entries: list, top: int) -> DataFrame:
    """``number, doc_id, score`` of the best documents for items; ``entries`` are rows (item number, term, count) by item."""
    terms = Terms.of(sorted({bytes(e[1]) for e in entries}))
    first = np.append(0, np.cumsum(np.bincount([e[0] for e in entries])))
    items = Items(first, np.array([terms.index[bytes(e[1])] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))
    index = Kept(postings(docs, terms), "postings")
    documents, count = index.df.agg(F.sum("documents"), F.sum("terms")).first()
    scoring = Scoring(documents or 0, count or 1)
    held, most = _term_counts(index.df, len(terms.term))
    weight = np.array([scoring.weight(n) for n in held.tolist()], np.int64)
    # No document is shorter than one of a single term.
    largest = Scoring.share(most, np.full(len(most), 75))
    # Plain values: what is broadcast names no class that a worker would have to import.
    plan = spark.sparkContext.broadcast((tuple(items), owners_of(held, OWNERS), weight, largest, tuple(scoring)))
    empty = F.lit(b"")
    bundles = index.df.select("shard", F.explode(F.sequence(F.lit(0), F.lit(items.bundles - 1))).alias("bundle"))
    bundles = bundles.select("shard", "bundle", empty.alias("starts"), empty.alias("documents"), empty.alias("scores"))
    for stage in range(OWNERS):
        bundles = _stage(bundles, index.df, stage, plan, top)
    return bundles


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with a score above 0, equal scores by doc_id."""
    spark = docs.sparkSession
    entries = Kept(item_entries(items), "items")
    sizes = entries.df.groupBy("item").agg(F.count("*").alias("n"))
    total, count = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = max(-(-total // MOST_ENTRIES), -(-count // MOST_ITEMS))
    id_type = items.schema["item_id"].dataType.simpleString()
    result = None
    for group in range(groups):
        rows = entries.df.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).orderBy("item", "term").collect()
        if not rows:
            continue
        number = {item: k for k, item in enumerate(dict.fromkeys(r.item for r in rows))}
        found = _searched(spark, docs, [(number[r.item], r.term, r["count"]) for r in rows], top)
        names = spark.createDataFrame([(k, item) for item, k in number.items()], "number int, item string")
        ids = names.join(spark.createDataFrame(list({r.item: (r.item, r.item_id) for r in rows}.values()), f"item string, item_id {id_type}"), "item")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.join(ids, "number").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.union(ranked)
    return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long") if result is None else result
