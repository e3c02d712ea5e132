"""Whitening, SimHash groups and ranked search against brute force, on awkward rows and with small bounds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")

from stridelake.llm import ranked, simhash, whitening  # noqa: E402
from stridelake.llm import words as W  # noqa: E402

rng = random.Random(11)
VOCABULARY = ["the", "Cat", "sat", "über", "日本", "x", "a1", "and", "mat,", "ran.", "🙂", "no!", "e-f", "extraordinarilylongword", "incomprehensibilities"]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def lowered(value):
    return re.sub("[A-Z]", lambda m: m[0].lower(), value or "")


# ---- whitening


def expected_whitening(rows, scale, offset, count):
    """By numpy's symmetric eigenvalues, of the rows' distinct grid vectors."""
    cells = {k: np.floor(scale * np.array(v, float)).astype(np.int64) + offset for k, v in rows}
    fit = np.unique(np.array(list(cells.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    out = {k: ((x - total / n) @ vectors / np.sqrt(values), sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, total))) for k, x in cells.items()}
    return n, values / np.trace(centred.T @ centred / n), out


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 0.5, "c") for k, v in rows], "vec_id long, embedding array<float>, n int, whitened double, cells string")


def check_whitening(spark, rows, usable, width, count=16):
    found = whitening.whitened(vectors(spark, rows), components=count, scale=64, offset=1_000_000).collect()
    n, explained, out = expected_whitening(usable, 64, 1_000_000, min(count, width))
    assert len(found) == len(usable) * min(count, width)
    for c in range(1, min(count, width) + 1):
        mine = np.array([r.whitened for r in found if r.component == c])
        want = np.array([out[r.vec_id][0][c - 1] for r in found if r.component == c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert all(abs(r.explained - explained[c - 1]) <= 1e-6 * explained[c - 1] for r in found if r.component == c)
    assert all(r.n == n and r.deviation == out[r.vec_id][1] and r.identity_error < 1e-6 for r in found)
    return found


def test_whitening_of_awkward_rows(spark):
    spread = np.random.default_rng(3)
    good = [(i, (spread.normal(size=6) * [1, 30, 0.2, 5, 90, 2]).astype(np.float32).tolist()) for i in range(200)]
    good += [(300 + i, good[0][1]) for i in range(50)] + [(None, good[1][1])]
    bad = [(400, None), (401, [None] * 6), (402, [1.0] * 5 + [None]), (403, [math.nan] * 6), (404, [math.inf] + [0.0] * 5), (405, [1.0] * 7), (406, []), (407, [3e30] * 6)]
    check_whitening(spark, good + bad, good, 6)


def test_whitening_keeps_small_components(spark):
    """Columns that nearly agree: the smallest variance is a ten-millionth of the largest."""
    spread = np.random.default_rng(4)
    base = spread.normal(size=400) * 4000
    rows = [(i, [float(b), float(np.float32(b + e)), float(s)]) for i, (b, e, s) in enumerate(zip(base.astype(np.float32), spread.normal(size=400), spread.normal(size=400)))]
    check_whitening(spark, rows, [(k, np.float32(v)) for k, v in rows], 3)


def test_whitening_without_some_directions(spark):
    spread = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), 2 * float(a), 7.0]) for i, (a, b) in enumerate(spread.integers(-9, 9, (90, 2)))]
    found = whitening.whitened(vectors(spark, rows), components=16, scale=64).collect()
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-6
    for same in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], []):
        empty = whitening.whitened(vectors(spark, same))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_substitution_and_composed_factor():
    spread = np.random.default_rng(6)
    rows = spread.normal(size=(500, 8)) @ np.diag(10.0 ** -np.arange(8))
    factor = np.triu(spread.normal(size=(8, 8))) + 4 * np.eye(8)
    assert np.allclose(whitening.solved(rows, [factor]) @ factor, rows)

    def gram(factors):
        q = whitening.solved(rows, factors)
        return q.T @ q

    r = whitening.composed_factor(gram, 500, 8)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(rows, compute_uv=False), rtol=1e-9)


def test_packed_rows_return():
    cells = np.array([[1, -2, 3], [1 << 40, 0, -5], [7, 8, 9]])
    rows = np.concatenate(list(whitening.unpacked(pa.array(whitening.packed(cells), pa.binary()), 3)))
    assert sorted(map(tuple, rows.tolist())) == sorted(map(tuple, cells.tolist()))


# ---- SimHash


def expected_fingerprint(value, n=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(value))
    grams = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_roots(codes):
    """The first position reachable within two bits, by comparing all pairs."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(codes)):
        for i in range(j):
            if (codes[i] ^ codes[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def near_codes(n, clusters):
    """Fingerprints of which many are near others, some by a chain."""
    out = set()
    for _ in range(clusters):
        code = rng.getrandbits(64)
        for _ in range(n // clusters):
            out.add(code)
            code ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 5])))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 3, 2048])
def test_links_are_those_of_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    codes = near_codes(400, 20) + [0, 1, 3, 7, (1 << 64) - 1]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    pairs = simhash.simhash_links(spark.createDataFrame([(c,) for c in signed], "code long")).collect()
    at = {c: i for i, c in enumerate(signed)}
    assert all((codes[at[r.a]] ^ codes[at[r.b]]).bit_count() <= 4 or bucket > 1 for r in pairs)
    linked = list(range(len(codes)))

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for r in pairs:
        a, b = find(at[r.a]), find(at[r.b])
        linked[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(codes))] == expected_roots(codes)


def test_coordinates_bound_the_distance():
    codes = np.array(near_codes(200, 5), np.uint64)
    table = simhash.coordinates(codes).astype(int)
    for i in range(0, len(codes), 7):
        assert (np.abs(table - table[i]).max(1) <= np.bitwise_count(codes ^ codes[i])).all()
    keys = simhash.bucket_keys(codes)
    for i in range(len(codes)):
        near = np.bitwise_count(codes ^ codes[i]) <= 2
        assert (keys[near] == keys[i]).any(1).all()


def test_simhash_groups_of_awkward_rows(spark):
    long = text(40_000)
    base = [text(300) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, base[0]), (3, base[0]), (4, base[0] + " more"), (5, long), (6, long + " the end"), (7, "z" * 5000), (8, "one two"), (9, "One  TWO"),
            (None, base[1]), (10, base[1].upper()), (11, base[1].replace(" ", "\n")), (12, "one"), (9, "another text here")]
    rows += [(20 + i, " ".join([*base[2].split()[:i], "new", *base[2].split()[i:]])) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "k", 1) for d, t in rows], "doc_id long, text string, lang string, code string, least int")
    found = simhash.simhash_groups(docs).collect()
    codes = [expected_fingerprint(t) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    root = dict(zip(known, expected_roots([codes[i] for i in known])))
    least = {}
    for i in known:
        least[root[i]] = min(least.get(root[i], 1 << 60), rows[i][0])
    want = Counter((rows[i][0], f"{codes[i]:016x}", least[root[i]] if i in root else None) for i in range(len(rows)))
    assert Counter(tuple(r) for r in found) == want
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


# ---- ranked search


def expected_ranking(docs, items, top=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    counts = [(d, Counter(pattern.findall(lowered(t)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    held = Counter(t for _, c, _ in counts for t in c)
    n, total = len(counts), sum(x[2] for x in counts)
    out = Counter()
    for item, value in dict.fromkeys(items):
        terms = pattern.findall(lowered(value))
        scored = []
        for d, c, size in counts:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, unknown, d) in enumerate(sorted(scored)[:top], 1):
            out[(item, rank, None if unknown else d, -score)] += 1
    return out


DOCS = [(i, text(rng.choice([3, 30, 300])) + f" word{i % 40} word{i % 7}") for i in range(300)]
DOCS += [(400, None), (401, ""), (402, "!!! ---"), (5, DOCS[5][1]), (None, DOCS[6][1]), (500, DOCS[6][1]), (501, text(30_000)), (502, "word3"), (503, "word3")]
ITEMS = [(1, "the cat word3 word3 Word5"), (2, None), (3, ""), (4, "word39 incomprehensibilities extraordinarilylongword"), (4, "word1"), (1, "the cat word3 word3 Word5"),
         (None, "word2 über 日本"), (7, "nowhere"), (8, "x a1 mat ran and no sat"), (9, text(2000))]


@pytest.mark.parametrize("bounds", [{}, {"SHARD_DOCUMENTS": 16, "BUNDLE_ITEMS": 2}, {"OWNERS": 1}, {"OWNERS": 7, "SHARD_POSTINGS": 40}, {"MOST_ENTRIES": 8}])
def test_search_is_that_of_all_scores(spark, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(ranked, name, value)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in DOCS], "doc_id long, text string, score int, shard string").repartition(3)
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, rank int")
    found = ranked.search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == expected_ranking(DOCS, ITEMS)
    if not bounds:
        assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []


def test_terms_are_told_apart_by_their_bytes(monkeypatch):
    """With hashes that all agree, or agree by length, the right terms are found."""
    known = [b"cat", b"car", b"incomprehensibilities", b"incomprehensibilitiez", b"abcdefgh", b"abcdefghij", b"bbcdefghij"]
    value = " ".join(x.decode() for x in known) + " cap incomprehensibilitiex abcdefghik zzz"
    for code in (lambda data, start, end: np.zeros(len(start), np.uint64), lambda data, start, end: (end - start).astype(np.uint64)):
        monkeypatch.setattr(W, "segment_codes", code)
        terms = ranked.Terms.of(known)
        words = ranked.split_terms(*W.text_bytes(pa.array([value])))
        assert terms.find(words).tolist() == [*range(len(known)), -1, -1, -1, -1]


def test_owners_hold_equal_shares_from_rare_to_common():
    held = np.array([5, 100, 1, 1, 50, 43])
    owner = ranked.owners_of(held, 4)
    assert owner[np.argsort(held, kind="stable")].tolist() == sorted(owner.tolist()) and owner.max() <= 3
    assert ranked.owners_of(np.zeros(0, np.int64), 4).tolist() == []


def test_ranked_search_on_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = Counter(tuple(r) for r in ranked.search(docs, items.where(F.col("item_id") % 5 == 0)).collect())
    chosen = [(r.item_id, r.text) for r in items.collect() if r.item_id % 5 == 0]
    assert found == expected_ranking([(r.doc_id, r.text) for r in docs.collect()], chosen)
