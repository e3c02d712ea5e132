"""Hot groups in the text operators: short texts, hubs, settled entries, huge documents, rare languages."""

from __future__ import annotations

import os
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyspark.sql.functions as F
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stridelake.llm import graph, jaccard, substrings, tokens, toxicity  # noqa: E402

rng = random.Random(3)


def random_sets(n, low, high, seed):
    r = np.random.default_rng(seed)
    return [np.unique(r.integers(0, 1 << 63, int(k), dtype=np.uint64)) for k in r.integers(low, high, n)]


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5)])
def test_unrelated_small_sets_share_no_part(t):
    bounds = jaccard.SizeBounds(t)
    sets = [s for s in random_sets(20_000, 1, 14, 1) if bounds.differences(len(s))]
    codes = Counter(c for s in sets for c in set(jaccard.part_codes(s, bounds).tolist()))
    assert len(sets) > 5000 and max(codes.values()) <= 25
    for size in (50, 700, 1500):
        large = Counter(c for s in random_sets(200, size * 9 // 10, size * 11 // 10, 2) for c in set(jaccard.part_codes(s, bounds).tolist()))
        assert max(large.values()) <= 10


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5)])
def test_similar_sets_share_a_part(t):
    """Of two sets at the bound or above it, whatever their size, some part goes out for both; smaller sets are equal or apart."""
    bounds, r = jaccard.SizeBounds(t), np.random.default_rng(7)
    tried = 0
    for _ in range(6000):
        size = int(r.integers(2, 60))
        base = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        gone, fresh = int(r.integers(0, 6)), int(r.integers(0, 6))
        other = np.unique(np.concatenate([base[gone:], r.integers(0, 1 << 63, fresh, dtype=np.uint64)]))
        if not len(other) or not len(base):
            continue
        shared = len(np.intersect1d(base, other))
        if np.array_equal(base, other) or shared * t.denominator < t.numerator * (len(base) + len(other) - shared):
            continue
        tried += 1
        assert bounds.differences(len(base)) and bounds.differences(len(other))
        assert set(jaccard.part_codes(base, bounds).tolist()) & set(jaccard.part_codes(other, bounds).tolist())
    assert tried > 200


def test_short_texts_end_to_end(spark, monkeypatch):
    """Thousands of unrelated texts of one to five words: no two meet as candidates, and copies are found."""
    words = [f"w{i}" for i in range(3000)]
    texts = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(4000)})
    docs = spark.createDataFrame(list(enumerate(texts + texts[:40])), "doc_id long, text string")
    seen = []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda live, groups, *a: seen.append(groups.groupBy("group").count().agg(F.max("count")).first()[0]) or links(live, groups, *a))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, 3, Fraction(9, 10)).collect()}
    assert all(found[len(texts) + i] == i for i in range(40)) and sum(d != c for d, c in found.items()) == 40
    assert seen == [None]


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_sketches_part_no_similar_sets(t):
    """Sets at the bound or above it stay together, of any size and also folded; unrelated ones are told apart."""
    bounds, r = jaccard.SizeBounds(t), np.random.default_rng(11)
    for size in (1, 9, 64, 65, 500, 1024, 1030, 6000, 20_000):
        base = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        room = bounds.differences(len(base))
        close = [base, base[room // 2 :], np.concatenate([base, r.integers(0, 1 << 63, room, dtype=np.uint64)])]
        far = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        for a in close:
            shared = len(np.intersect1d(base, a))
            assert shared * t.denominator >= t.numerator * (len(base) + len(a) - shared)
            apart = jaccard.alike([jaccard.sketch(x) for x in (far, base, a)], np.array([len(far), len(base), len(a)]), bounds)
            assert apart[1] == apart[2] and (apart[1] == 1 or size < 9 or size > 6000 or t < Fraction(4, 5))
            assert jaccard.alike([jaccard.sketch(x) for x in (base, a)], np.array([len(base), len(a)]), bounds)[1] == 0
    sketches = jaccard.sketch(np.arange(1, 5000, dtype=np.uint64))
    assert (jaccard.fold(sketches, 4) == jaccard.fold(jaccard.fold(sketches, 16), 4)).all()


def test_shared_passages_make_no_candidates(spark, monkeypatch):
    """Texts that share passages and little else meet in parts, but form no candidate groups; near copies among them do."""
    passages = [" ".join(f"p{k}_{i}" for i in range(70)) for k in range(6)]
    texts = [" ".join([*rng.sample(passages, 2), *(f"x{d}_{i}" for i in range(90))]) for d in range(500)]
    copies = [t.replace(f"x{d}_10 ", f"y{d} ") for d, t in enumerate(texts[:20])]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    seen, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda live, groups, *a: seen.append(groups.groupBy("group").count().agg(F.max("count")).first()[0]) or links(live, groups, *a))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    assert found == {i: i if i < 500 else i - 500 for i in range(520)} and seen == [2]


@pytest.mark.parametrize("rows", [2, 5])
def test_groups_of_sketches_in_blocks(spark, monkeypatch, rows):
    """A group of near copies that spans several blocks, some of one row, and batches of a few rows, stays one group."""
    monkeypatch.setattr(jaccard, "SKETCH_ROWS", rows)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 40, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.component_id for r in jaccard.jaccard_groups(docs).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("edges_of_a_hub", [4, 1000])
def test_components_with_hubs(spark, monkeypatch, edges_of_a_hub):
    monkeypatch.setattr(graph, "HUB_EDGES", edges_of_a_hub)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 440)] + [(1000 + i, 1000) for i in range(1, 60)] + [(1059, 2000), (299, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_no_task_meets_a_whole_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 50)
    directed = spark.range(1, 5001).select(F.lit(0).cast("long").alias("n"), F.col("id").alias("m"))
    joined = graph._with_least(directed, F.min("m"), 50)
    assert joined.count() == 5000 and joined.agg(F.max("least")).first()[0] == 1
    dealt = joined.repartition(64, "n", F.pmod(F.xxhash64("m"), F.lit(100))).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 500


def test_settled_entries_spread_over_parts(spark, monkeypatch):
    """Blocks with repeats inside: their settled entries go to parts all over, whichever task sends them."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} own{i} " + " ".join(f"x{i}_{k}" for k in range(40))) for i in range(400)], "doc_id long, text string").repartition(4)
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("alive", F.lit(None).cast("binary"))
    parts = Counter(r.part for r in substrings._send(keyed, 7, 13, 40).where("settled").select("part").collect())
    assert sum(parts.values()) > 60 and len(parts) >= 25 and max(parts.values()) <= 12


def test_a_huge_document_still_gets_a_dictionary(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    huge = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(300_000))
    rows = [(0, huge)] + [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sample = tokens._sample(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2)
    assert len(sample) == 200 and max(map(len, sample)) <= tokens.DICTIONARY_SLICE_BYTES
    folder = tokens.write_tokens(docs, str(tmp_path / "store"), public_tokenizers.path("byte_bpe_50k.json"))
    assert len(spark.read.parquet(f"{folder}/dictionary").first().bytes) > 1000
    assert len(tokens.read_documents(spark, folder, [0]).first().ids) > 300_000


def test_terms_are_chosen_until_texts_are_covered():
    common = {f"c{i}": list(range(100)) for i in range(20)}
    rare = {"r1": [200, 201, 202, 203], "r2": [200, 201, 202, 204]}
    chosen = toxicity.covering(common | rare, cover=3)
    assert len([t for t in chosen if t.startswith("c")]) == 3 and {"r1", "r2"} <= set(chosen)
    assert toxicity.covering({}, 3) == []


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the larger tables")
def test_held_out_recall_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    scored = model.scored(docs.select("doc_id", "text", "lang"), "score").where(toxicity.id_remainder(5) == 0).join(labels.where("toxic is not null"), "doc_id")
    hit = F.col("score") >= 0.5
    rows = scored.groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.sum(F.when(hit, F.col("toxic"))).alias("hit"), F.sum(F.when(hit, 1 - F.col("toxic"))).alias("false"), F.count("*").alias("n")).collect()
    assert all(r.hit >= 0.85 * r.toxic for r in rows if r.toxic >= 10) and sum(r.toxic >= 10 for r in rows) >= 3
    assert all(r["false"] <= 0.02 * r.n for r in rows)
