from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stridelake.operators import labels as L
from stridelake.operators import sampling as S
from stridelake.operators.ranges import rank_by_ranges, sums_by_ranges


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, y string")


def codes(df, column="y_id"):
    return [r[column] for r in df.orderBy("i").collect()]


def test_sorted_codes(spark):
    df = texts(spark, "walk", "sit", "walk", None, "sitting", "bike", "é")
    assert codes(L.encode_sorted(df, "y")) == [3, 1, 3, None, 2, 0, 4]


def test_first_seen_codes_differ_from_sorted_ones(spark):
    df = texts(spark, "walk", "sit", "walk", "bike")
    assert codes(L.encode_first_seen(df, "y", ["i"])) == [1, 2, 1, 3]


def test_unknown_text_gets_no_code_and_is_counted(spark):
    df = L.encode_vocab(texts(spark, "sit", "run", "run", "walk"), "y", ["walk", "sit"])
    assert codes(df) == [1, None, None, 0]
    assert [tuple(r) for r in L.unknown_labels(df, "y").collect()] == [("run", 2)]


def test_prefix_codes_take_the_first_match(spark):
    df = L.encode_vocab(texts(spark, "dws_1", "up", "ups_3"), "y", ["dws", "ups", "u"], match="prefix")
    assert codes(df) == [0, 2, 1]


@pytest.mark.parametrize("small", [None, True, False])
def test_a_large_vocabulary_is_numbered(spark, monkeypatch, small):
    monkeypatch.setattr(L, "MAX_BROADCAST", 10)
    names = [f"Supplier#{i:09d}" for i in range(3000)]
    df = texts(spark, *(names[(7 * i) % 3000] for i in range(3000)), None)
    got = df.select("i", "y").join(L.encode_sorted(df, "y", small=small).select("i", "y_id"), "i").collect()
    assert all(r.y_id == (None if r.y is None else int(r.y[9:])) for r in got) and len(got) == 3001
    first = L.encode_first_seen(df, "y", ["i"], small=small).collect()
    assert all(r.y_id == (None if r.y is None else r.i + 1) for r in first)


def jobs_of(spark, build):
    """What ``build`` returns and how many jobs it started."""
    spark.sparkContext.setJobGroup("built", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("built"))
    made = build()
    started = set(spark.sparkContext.statusTracker().getJobIdsForGroup("built")) - before
    spark.sparkContext.setJobGroup("", "")
    return made, len(started)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_ranks_and_sums_by_ranges(spark, ranges):
    """Ties of the first column, nulls, negative numbers; no partition has more than its share; nothing runs while building."""
    rng = random.Random(ranges)
    rows = [(rng.choice([None, *range(-3, 9)]), i, rng.randrange(5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, i int, v int")
    ranked_, jobs = jobs_of(spark, lambda: rank_by_ranges(df, ["a", "i"], "place", start=3, ranges=ranges))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert jobs == 0 and [r.i for r in sorted(ranked_.collect(), key=lambda r: r.place)] == [r[1] for r in order]
    assert sorted(r.place for r in ranked_.collect()) == list(range(3, 4003))
    summed, jobs = jobs_of(spark, lambda: sums_by_ranges(df, ["a", "i"], {"v": "v"}, descending=True, ranges=ranges))
    want, so_far = {}, 0
    for r in reversed(order):
        want[r[1]], so_far = so_far, so_far + r[2]
    assert jobs == 0 and {r.i: r.v_before for r in summed.collect()} == want and {r.v_total for r in summed.collect()} == {so_far}
    assert "Reused" in ranked_._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in df.repartitionByRange(ranges, "a", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 4000 / ranges * 1.6 + 40
    assert rank_by_ranges(df.limit(0), ["a"], "place").collect() == []


def test_ranges_computed_twice_end_the_query(spark):
    """Without reuse, bounds are sampled again; rows outside their partition's bounds are not passed on."""
    from stridelake.operators import ranges as G

    df = spark.createDataFrame([(i,) for i in range(100)], "a int")
    placed = G._ranged(df, ["a"], False, 4)
    wrong = spark.createDataFrame([(p, 0, 10, 0) for p in range(4)], "_part long, x int, y int, _base long").withColumn("_sum", F.lit(1))
    wrong = wrong.select("_part", "_base", "_sum", F.struct(F.col("x").alias("a")).alias("_least"), F.struct(F.col("y").alias("a")).alias("_most"))
    with pytest.raises(Exception, match="computed twice"):
        G._with_offsets(placed, wrong, ["a"]).count()


def test_resolve_label():
    names = ["sit", "walk"]
    assert L.resolve_label(names, "1") == 1 and L.resolve_label(names, "sit") == 0
    for bad in ("2", "run"):
        with pytest.raises(ValueError):
            L.resolve_label(names, bad)


def ranked(n, seed):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [1, 7, 10, 99, 1000])
@pytest.mark.parametrize("digits", [1, 4])
def test_split_sizes_and_members_are_exact(spark, n, digits):
    rows = S.split(spark.range(n), "id", 5, 0.8, 0.1, digits).collect()
    order = ranked(n, 5)
    train, vali = int(n * 0.8), int(n * 0.1)
    part = {p: {r.id for r in rows if r.split == p} for p in ("train", "vali", "test")}
    assert part == {"train": set(order[:train]), "vali": set(order[train : train + vali]), "test": set(order[train + vali :])}


def test_shuffle_positions(spark):
    rows = S.shuffle(spark.range(200), "id", 9).orderBy("position").collect()
    assert [r.id for r in rows] == ranked(200, 9) and [r.position for r in rows] == list(range(200))


def test_the_order_does_not_depend_on_partitions(spark):
    parts = [S.split(spark.range(0, 500, 1, k), "id", 1).orderBy("id").collect() for k in (1, 4, 16)]
    assert parts[0] == parts[1] == parts[2]


@pytest.mark.parametrize("rate,size", [(0.0, 0), (0.0001, 0), (0.25, 25), (1.0, 100)])
def test_labelled_sample_size(spark, rate, size):
    assert S.sample_labelled(spark.range(100), "id", rate, 3).filter("labelled").count() == size


@pytest.mark.parametrize("rate,quota", [(0.3, 10), (0.9, 12), (0.0, 0)])
def test_balanced_sample_takes_the_same_number_of_each_class(spark, rate, quota):
    # 60 of one class, 28 of another, 12 of the third: a quota above 12 is cut to 12.
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 60, 0).when(F.col("id") < 88, 1).otherwise(2))
    counts = S.sample_balanced(df, "id", "y", rate, 3).groupBy("y").agg(F.sum(F.col("labelled").cast("int"))).collect()
    assert {r[1] for r in counts} == {quota}
    report = S.balanced_quota(df, "y", rate).first()
    assert (report.quota, report.uses_all_of_smallest) == (quota, quota == 12)


def test_rows_without_a_class_are_never_chosen(spark):
    df = spark.range(20).withColumn("y", F.when(F.col("id") >= 10, F.col("id") % 2))
    chosen = S.sample_balanced(df, "id", "y", 1.0, 3).filter("labelled").collect()
    assert len(chosen) == 10 and all(r.id >= 10 for r in chosen)


def test_composite_and_zero_base(spark):
    df = spark.createDataFrame([(3, 5), (4, 2)], "a int, b int")
    assert sorted(r.composite for r in L.composite_label(df, ["a", "b"]).collect()) == [35, 42]
    assert sorted((r.a, r.b) for r in L.zero_base(df, ["a", "b"]).collect()) == [(0, 3), (1, 0)]


def test_take_random_is_a_prefix_of_the_shuffle(spark):
    assert [r.id for r in S.take_random(spark.range(50), "id", 7, 2).collect()] == ranked(50, 2)[:7]
