"""Exact Jaccard join of documents on word n-grams, with the groups that links form.

Documents are rows of a sparse incidence matrix with n-grams as columns, and overlap counts are entries of its product
with itself.  The product is never made whole; bounds derived from sizes pick and prune its blocks:

1. Equal rows are collapsed: documents with one n-gram set share a 64-bit ``code`` of the set.
2. Columns with one entry add to no overlap.  Half of the columns (by hash) are counted; a set of size x that has more
   than ``x (1 - t)`` lone ones among them cannot reach similarity t with any other and is done.
3. Columns of the sets that are left are dealt by hash into parts.  Two sets of sizes x <= y with a similarity of t or
   more differ in at most ``x (1 - t) / t`` n-grams, so with one part more than that, some part of both is equal.  The
   number of parts follows from the size class (a factor of 1/t wide); a set takes part in its own class and, as the
   larger one, in the class below.  Sets that share a part are compared by size and by a sketch (a parity per hashed bit:
   bits that differ are n-grams that differ, so no similar pair is lost); those that may be similar become candidates:
   a star per group, never its pairs.  A part of few n-grams says little, so there are some more parts, and such thin parts count only for sets that
   have more of them than that; if all equal parts of a pair are thin, both its sets do.  An empty part says nothing: it
   counts only for a set that has no more other parts than the n-grams it may differ in, for else one of those is equal.
   A set too small to differ in one n-gram is equal to another or not linked, so it seeks no candidates.
4. Candidate groups are cut into row blocks, and blocks are multiplied pair by pair: columns in strips, overlaps
   accumulated strip by strip, pairs discarded as soon as what is left cannot reach the overlap their sizes demand.
   A block pair yields the forest of its links, at most one row per document, not its pairs.

Work is in proportion to the documents but for candidate groups above a block (``BLOCK_ROWS`` sets): of those, all
pairs of blocks are multiplied, which is exact, and quadratic in the number of blocks of *different* similar sets.  Sketches
of the sets that share one part are compared in blocks too (``SKETCH_ROWS``).

Empty and null texts have no n-grams and link with nothing.  A text of fewer words than ``n`` has its whole word
sequence as its one n-gram.  Repeated rows are copies of each other.  Rows without ``doc_id`` take part in no group:
their ``component_id`` is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stridelake.llm import words as W
from stridelake.llm.graph import components
from stridelake.llm.store import Kept, bytes_of, kept_table

#: Sets of a row block, and the n-grams of all sets of a block (about).
BLOCK_ROWS, BLOCK_ITEMS = 384, 1 << 20
#: Columns of a strip of the product.
STRIP = 4096
#: Bytes of text per part of the hash space when columns are counted, and of text settled at a time.
COUNT_BYTES = 64 << 20
#: Sets of a block when sketches are compared, and the longest sketch (2^12 bits: unlike sets of up to some 9,000 n-grams are told
#: apart; of longer ones more pairs go on to the product).
SKETCH_ROWS, SKETCH_BITS = 1024, 12


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data, offsets = W.text_bytes(column)
    for a, b in W.pieces(offsets):
        found = W.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.spaces_table(), W.lower_table())
        codes = W.window_codes(found.code, n)
        for i, j in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            if j - i >= n:
                yield np.unique(codes[i : j - n + 1])
            elif j > i:
                yield W.window_codes(found.code[i:j], j - i) ^ np.uint64(j - i)
            else:
                yield np.zeros(0, np.uint64)


def set_code(grams: np.ndarray) -> int:
    """A 64-bit code of a set of hashes."""
    if not len(grams):
        return 0
    mixed = W.mix(grams + np.uint64(0x632BE59BD9B4E019))
    code = W.mix(mixed.sum(keepdims=True) * np.uint64(3) ^ np.bitwise_xor.reduce(W.mix(mixed), keepdims=True) ^ np.uint64(len(grams)))
    return int(code.view(np.int64)[0])


class SizeBounds:
    """What a similarity of ``t`` or more demands of set sizes."""

    def __init__(self, t: Fraction):
        self.t = t
        # A part holds about t / (1 - t) n-grams.  Parts beyond the bound, and the n-grams below which a part is thin.
        self.spare, self.thin = (3, 2) if t / (1 - t) >= 8 else (6, 1)
        self.classes = [1]  # first size of each class

    def _class(self, size: int) -> int:
        while self.classes[-1] <= size:
            # The first size that is not similar to the class's first one.
            self.classes.append(int(self.classes[-1] / self.t) + 1)
        return int(np.searchsorted(self.classes, size, "right")) - 1

    def parts(self, size: int) -> list[tuple[int, int]]:
        """(class, number of parts) that a set of this size takes part in."""
        own = self._class(size)
        found = []
        for c in (own, own - 1) if own else (own,):
            widest = self.classes[c + 1] - 1
            found.append((c, int(widest * (1 - self.t) / self.t) + 1 + self.spare))
        return found

    def differences(self, size: int) -> int:
        """n-grams in which a set of this size may differ from a similar one."""
        return int(size * (1 - self.t) / self.t)

    def overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least overlap of sets of sizes x and y at this similarity."""
        a, b = self.t.numerator, self.t.numerator + self.t.denominator
        return -(-(a * (x + y)) // b)


def part_codes(grams: np.ndarray, bounds: SizeBounds) -> np.ndarray:
    """Codes of the parts of a set."""
    found = []
    for c, m in bounds.parts(len(grams)):
        # The part of an n-gram comes from bits that its code in the part does not depend on alone.
        part = ((grams >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        mixed = W.mix(grams + np.uint64(c + 1))
        low = np.bincount(part, (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
        high = np.bincount(part, (mixed >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
        codes = W.mix(W.pair(low, high) + W.mix(np.arange(m, dtype=np.uint64) * np.uint64(100_003) + np.uint64(c)))
        filled = np.bincount(part, minlength=m)
        told = filled >= (1 if (filled < bounds.thin).sum() > bounds.spare else bounds.thin)
        # In either class the smaller of two similar sets is no larger than its widest, which bounds the differences too.
        if (filled > 0).sum() <= min(bounds.differences(len(grams)), m - 1 - bounds.spare):
            told |= filled == 0
        found.append(codes[told])
    return np.concatenate(found)


def _described(docs: DataFrame, n: int) -> DataFrame:
    def describe(batches):
        for batch in batches:
            sets = list(ngram_sets(batch.column("text"), n))
            codes = pa.array([set_code(g) if len(g) else None for g in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_code"), pa.array([len(g) for g in sets], pa.int64()), codes],
                                             names=["doc_id", "text_code", "n_shingles", "code"])

    return docs.mapInArrow(describe, "doc_id long, text_code long, n_shingles long, code long")


def _lone(docs: DataFrame, n: int) -> DataFrame:
    """``code, lone``: counted columns that a set has alone; sets without any have no row.

    Hashes go out in packed arrays, a row per batch and part of the hash space, four bytes each: columns that agree by
    chance only hide a lone one.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // COUNT_BYTES))

    def send(batches):
        seen = set()
        for batch in batches:
            codes, grams = [], []
            for g in ngram_sets(batch.column("text"), n):
                code = set_code(g)
                if len(g) and code not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(code)
                    codes.append(code)
                    grams.append(g[g & np.uint64(1) == 0])
            if not codes:
                continue
            owner = np.repeat(np.arange(len(codes)), [len(g) for g in grams])
            code, gram = np.array(codes, np.int64), np.concatenate(grams)
            part = ((gram >> np.uint64(41)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edges)):
                one = order[edges[p] : edges[p + 1]]
                runs = np.flatnonzero(np.append(True, owner[one][1:] != owner[one][:-1]))
                raw = (gram[one] >> np.uint64(1)).astype("<u4").tobytes()
                rows.append((int(p), code[owner[one][runs]].tobytes(), np.diff(np.append(runs, len(one))).astype("<u4").tobytes(), raw))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "codes", "counts", "grams"])

    def settle(table: pa.Table) -> pa.Table:
        names, entries = np.unique(np.concatenate([np.frombuffer(c, np.int64) for c in bytes_of(table["codes"])])), [len(g) // 4 for g in bytes_of(table["grams"])]
        owner, gram, at = np.empty(sum(entries), np.int32), np.empty(sum(entries), np.uint32), 0
        for codes, counts, grams, size in zip(*(bytes_of(table[c]) for c in ("codes", "counts", "grams")), entries):
            owner[at : at + size] = np.repeat(np.searchsorted(names, np.frombuffer(codes, np.int64)).astype(np.int32), np.frombuffer(counts, "<u4"))
            gram[at : at + size] = np.frombuffer(grams, "<u4")
            at += size
        lone, slice_of = np.zeros(len(names), np.int64), (gram & np.uint32(15)).astype(np.uint8)
        for k in range(16):  # a share of the columns at a time bounds what sorting needs
            chosen = np.flatnonzero(slice_of == k)
            if len(chosen):
                chosen = chosen[np.argsort(gram[chosen], kind="stable")]
                edges = np.flatnonzero(np.append(True, np.diff(gram[chosen]) != 0))
                least, most = np.minimum.reduceat(owner[chosen], edges), np.maximum.reduceat(owner[chosen], edges)
                lone += np.bincount(least[least == most], minlength=len(names))
        return pa.table({"code": names[lone > 0], "lone": lone[lone > 0]})

    sent = docs.select("text").mapInArrow(send, "part int, codes binary, counts binary, grams binary")
    return sent.groupBy("part").applyInArrow(settle, "code long, lone long").groupBy("code").agg(F.sum("lone").alias("lone"))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams that fall on each of 2^k bits, about a bit per n-gram; halves of a sketch fold by xor.

    Bits in which two sketches differ are no more than the n-grams in which the sets differ.
    """
    bits = 1 << min(max(int(len(grams) - 1).bit_length(), 6), SKETCH_BITS)
    # A fold keeps the low bits of a place, so places are taken from the low end of the hash.
    odd = np.bincount((W.mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(parities: np.ndarray, words: int) -> np.ndarray:
    """A sketch cut to ``words`` words of 64 bits, a power of two."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def alike(sketches: list[np.ndarray], sizes: np.ndarray, bounds: SizeBounds) -> np.ndarray:
    """The smallest row that each row reaches by pairs whose sizes and sketches allow a link."""
    words = min(len(x) for x in sketches)
    folded = np.stack([fold(x, words) for x in sketches])
    near = np.zeros((len(sizes), len(sizes)), bool)
    step = max(1, (1 << 21) // (len(sizes) * words))
    for i in range(0, len(sizes), step):
        differ = np.bitwise_count(folded[i : i + step, None, :] ^ folded[None, :, :]).sum(2, dtype=np.int64)
        total = sizes[i : i + step, None] + sizes[None, :]
        need = bounds.overlap(sizes[i : i + step, None], sizes[None, :])
        near[i : i + step] = (differ <= total - 2 * need) & (need <= np.minimum(sizes[i : i + step, None], sizes[None, :]))
    head = np.arange(len(sizes))
    while True:
        lower = np.minimum(head, np.where(near, head[None, :], len(sizes)).min(1))
        lower = lower[lower]
        if (lower == head).all():
            return head
        head = lower


def _sharing(live: DataFrame, n: int, bounds: SizeBounds) -> DataFrame:
    """``group, code``: sets that share a part, by part; parts are runs of sorted rows that stream by.

    Parts shared by the same sets are one group where a batch holds them whole.
    """

    def unpack(batches):
        for batch in batches:
            codes, parts = [], []
            for code, grams in zip(batch.column("code").to_pylist(), ngram_sets(batch.column("text"), n)):
                parts.append(part_codes(grams, bounds).view(np.int64))
                codes.append(np.full(len(parts[-1]), code))
            for i in range(0, len(parts), 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[i : i + 500])) for x in (parts, codes)], names=["part", "code"])

    def shared(batches):
        before, part, code = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(last: bool):
            """Rows of shared parts, but for the last row unless it is the table's last."""
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            length = np.diff(np.append(starts, len(part)))
            group = part[starts].copy()
            whole = np.arange(len(starts)) < len(starts) - 1
            whole[0] &= before != part[0]
            members = np.add.reduceat(W.mix(code.view(np.uint64)), starts)
            group[whole] = W.mix(members[whole] + length[whole].astype(np.uint64)).view(np.int64)
            many = length > 1
            many[0] |= before == part[0]
            rows = np.repeat(many, length)
            rows[-1] &= last
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(group, length)[rows]), pa.array(code[rows])], names=["group", "code"])

        for batch in batches:
            part, code = (np.concatenate([held, np.asarray(batch.column(c))]) for held, c in ((part, "part"), (code, "code")))
            if len(part) > 1:
                yield found(last=False)
                before, part, code = part[-2], part[-1:], code[-1:]
        if len(part):
            yield found(last=True)

    rows = live.select("code", "text").mapInArrow(unpack, "part long, code long")
    return rows.repartition("part").sortWithinPartitions("part", "code").mapInArrow(shared, "group long, code long").distinct()


def _candidates(sharing: DataFrame, live: DataFrame, n: int, bounds: SizeBounds) -> DataFrame:
    """Pairs ``a, b`` of set codes that connect all pairs of sets that share a part and may be linked by their sketches.

    Without the sketches, parts made of passages that many documents share would connect most of a large corpus.
    """

    def describe(batches):
        for batch in batches:
            sketches = [sketch(g).tobytes() for g in ngram_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("n_shingles"), pa.array(sketches, pa.binary())], names=["code", "n_shingles", "sketch"])

    def compare(batches):
        """Rows come sorted by block pair; a pair is compared once its rows are together."""
        key, held = None, {}

        def pairs():
            codes = np.array(list(held), np.int64)
            head = alike([np.frombuffer(s, np.uint64) for _, s in held.values()], np.array([size for size, _ in held.values()]), bounds)
            tied = head != np.arange(len(head))
            return codes[head[tied]], codes[tied]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (list(zip(*found)) or [(), ()])], names=["a", "b"])

        for batch in batches:
            found = []
            for *k, code, size, parities in zip(*(batch.column(c).to_pylist() for c in ("group", "low", "high", "code", "n_shingles", "sketch"))):
                if k != key:
                    if len(held) > 1:
                        found.append(pairs())
                    key, held = k, {}
                held[code] = size, parities
            yield batch_of(found)
        if len(held) > 1:
            yield batch_of([pairs()])

    blocks = sharing.groupBy("group").agg(F.ceil(F.count("*") / SKETCH_ROWS).cast("int").alias("blocks"))
    dealt = sharing.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    sketches = live.select("code", "n_shingles", "text").mapInArrow(describe, "code long, n_shingles long, sketch binary")
    placed = dealt.join(sketches, "code").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "code", "n_shingles", "sketch")
    keys = ["group", "low", "high"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def product_links(left: list[np.ndarray], right: list[np.ndarray] | None, bounds: SizeBounds) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks of sets that are similar; with ``right`` None, pairs i < j of one block."""
    rows = left if right is None else left + right
    sizes = np.array([len(r) for r in rows])
    n = len(rows)
    grams, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(grams)) > 1
    keep = shared[column]
    column = (np.cumsum(shared) - 1)[column[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    a = np.arange(n) if right is None else np.arange(len(left))
    b = np.arange(n) if right is None else np.arange(len(left), n)
    need = bounds.overlap(sizes[a][:, None], sizes[b][None, :])
    alive = need <= np.minimum(sizes[a][:, None], sizes[b][None, :])
    if right is None:
        alive &= a[:, None] < b[None, :]
    overlap = np.zeros(alive.shape, np.float32)
    left_over = np.bincount(owner, minlength=n)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, STRIP):
        i, j = np.searchsorted(column, [low, low + STRIP])
        strip = np.zeros((n, STRIP), np.float32)
        strip[owner[i:j], column[i:j] - low] = 1
        live_a, live_b = alive.any(1), alive.any(0)
        if not live_a.any():
            break
        overlap[np.ix_(live_a, live_b)] += strip[a[live_a]] @ strip[b[live_b]].T
        left_over = left_over - np.bincount(owner[i:j], minlength=n)
        alive &= overlap + np.minimum(left_over[a][:, None], left_over[b][None, :]) >= need
    i, j = np.nonzero(alive & (overlap >= need))
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links (i, j) connect, without those that close a circle."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _links(live: DataFrame, groups: DataFrame, n: int, bounds: SizeBounds) -> DataFrame:
    """Forests of similar sets within candidate groups.  ``live``: code, n_shingles, text; ``groups``: code, group."""
    sized = live.select("code", "n_shingles").join(groups, "code")
    volume = sized.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("items"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    dealt = groups.join(volume.select("group", blocks.alias("blocks")), "group").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    with_text = live.select("code", "text").join(dealt, "code")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = with_text.select("code", "group", "block", "text", other).select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "code", "text")

    def multiply(batches):
        """Rows come sorted by block pair; a pair is multiplied once its rows are together."""
        key, held = None, {}

        def links():
            low, high = key[1], key[2]
            left, right = list(held.get(low, {}).items()), list(held.get(high, {}).items()) if high != low else []
            if len(left) + len(right) < 2 or (low != high and not (left and right)):
                return [], []
            i, j = product_links([s for _, s in left], [s for _, s in right] if low != high else None, bounds)
            codes = [c for c, _ in left + right]
            kept = forest(len(codes), i, j if low == high else j + len(left))
            return [codes[x] for x, _ in kept], [codes[y] for _, y in kept]

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "low", "high"))))
            blocks_, codes = batch.column("block").to_pylist(), batch.column("code").to_pylist()
            a, b = [], []
            for k, block, code, grams in zip(keys, blocks_, codes, ngram_sets(batch.column("text"), n)):
                if k != key:
                    if key is not None:
                        x, y = links()
                        a += x
                        b += y
                    key, held = k, {}
                held.setdefault(block, {})[code] = grams
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if key is not None:
            a, b = links()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["group", "low", "high"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(multiply, "a long, b long")


def jaccard_groups(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    ``docs`` needs ``doc_id, text``.  Texts are shuffled to find the sets that may have a partner, and those sets' texts
    once more; all else that is shuffled are codes.
    """
    return _grouped(docs, n, similarity).drop("text_code")


def _grouped(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    bounds = SizeBounds(Fraction(similarity))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_code"), F.col("text").cast("string").alias("text"))
    described = kept_table(_described(chosen, n), "sets")
    first = described.where("code is not null and doc_id is not null").groupBy("code").agg(
        F.min(F.struct("doc_id", "text_code")).alias("first"), F.first("n_shingles").alias("n_shingles"))
    most = F.floor(F.col("n_shingles") * (bounds.t.denominator - bounds.t.numerator) / bounds.t.denominator)
    differs = F.col("n_shingles") * (bounds.t.denominator - bounds.t.numerator) >= bounds.t.numerator
    likely = first.where(differs).join(_lone(chosen, n), "code", "left").where(F.coalesce("lone", F.lit(0)) <= most)
    kept = Kept(chosen.join(likely.select("first.doc_id", "first.text_code", "code", "n_shingles"), ["doc_id", "text_code"]).select(
        "code", "n_shingles", "doc_id", "text_code", "text").dropDuplicates(["doc_id", "text_code"]).drop("doc_id", "text_code"), "live")
    live = kept.df
    sharing = Kept(_sharing(live, n, bounds), "sharing")
    found = components(_candidates(sharing.df, live, n, bounds)).select(F.col("node").alias("code"), F.col("root").alias("group"))
    groups = found.union(found.select("group").distinct().select(F.col("group").alias("code"), "group"))
    sharing.release()
    linked = components(_links(live, groups, n, bounds)).select(F.col("node").alias("code"), "root")
    kept.release()
    smallest = first.select("code", F.col("first.doc_id").alias("doc_id")).join(linked, "code", "left").select("code", "doc_id", F.coalesce("root", "code").alias("root"))
    by_root = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_code = smallest.join(by_root, "root").select("code", "component_id")
    return described.join(of_code, "code", "left").select(
        "doc_id", "text_code", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows that repeat its id and text go too.

    Documents without n-grams, and rows without ``doc_id``, stay.
    """
    gone = _grouped(docs, n, similarity).where("doc_id is not null and doc_id <> component_id")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_code").alias("__code")).distinct()
    coded = docs.withColumn("__text", F.xxhash64("text"))
    kept = coded.where("doc_id is not null").join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__text") == F.col("__code")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__text"]).drop("__text").unionByName(docs.where("doc_id is null"))
