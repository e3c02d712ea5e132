from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.operators import joins as J
from stridelake.operators import windows as W

S = Stream(("s",), "t", ("i",), 10)


def nearest_label(t, labels):
    """The label of time t by search: first of equal times, later of equal distances."""
    once = {}
    for time, tie, name in sorted(labels, key=lambda x: (x[0], x[1])):
        once.setdefault(time, name)
    time = min(once, key=lambda x: (abs(x - t), -x))
    return time, once[time]


@pytest.mark.parametrize("width", [3, 50])
def test_nearest_join_matches_a_search(spark, width):
    rng = random.Random(11)
    samples, labels = [], {}
    for s in range(12):
        samples += [(s, t, i) for i, t in enumerate(rng.choices(range(100), k=15))]
        if s != 5:  # one recording has no labels
            labels[s] = [(rng.randrange(100), i, f"{s}-{i}") for i in range(1 if s == 3 else 9)]
    left = spark.createDataFrame(samples, "s int, t bigint, i int")
    right = spark.createDataFrame([(s, *row) for s, rows in labels.items() for row in rows], "s int, lt bigint, tie int, name string")
    stream = Stream(("s",), "t", ("i",), width)
    got = {(r.s, r.i): (r.matched_t, r["name"]) for r in J.join_nearest(left, right, stream, "lt", ["tie"], ["name"]).collect()}
    assert got == {(s, i): nearest_label(t, labels[s]) for s, t, i in samples if s in labels}


def test_segments_are_half_open_and_may_overlap(spark):
    rows = spark.range(10).select(F.lit(1).alias("s"), F.col("id").alias("seq"))
    segments = spark.createDataFrame([(1, 7, 0, 4), (1, 8, 3, 5), (1, 9, 6, 6), (2, 7, 0, 9)], "s int, activity int, start_idx bigint, end_idx bigint")
    for bucket in (1, 3, 100):
        got = sorted((r.seq, r.activity) for r in J.join_labels_segments(rows, segments, ["s"], bucket=bucket).collect())
        assert got == [(0, 7), (1, 7), (2, 7), (3, 7), (3, 8), (4, 8)]


def test_fused_ticks_need_both_sensors_and_one_label(spark):
    acc = spark.createDataFrame(
        [(1, 0, 0, "a", 1.0), (1, 2, 1, "a", 3.0), (1, 11, 2, "a", 5.0), (1, 40, 3, "a", 7.0), (1, 45, 4, "b", 9.0)],
        "s int, t bigint, i int, y string, x double",
    )
    gyro = spark.createDataFrame(
        [(1, 1, 0, "a", 10.0), (1, 12, 1, "a", 20.0), (1, 13, 2, "a", 40.0), (1, 46, 3, "b", 50.0)],
        "s int, t bigint, i int, y string, x double",
    )
    ticks = sorted(J.fuse_sensors(acc, gyro, S, ["x"], "y", 10).collect(), key=lambda r: r.tick_t)
    assert [(r.session, r.tick, r.y, r.acc_x, r.gyro_x, r.tick_t) for r in ticks] == [
        (0, 0, "a", 2.0, 10.0, 0), (0, 1, "a", 5.0, 30.0, 10), (2, 0, "b", 9.0, 50.0, 45),
    ]
    runs = J.tick_runs(J.fuse_sensors(acc, gyro, S, ["x"], "y", 10), S, 10)
    windows = W.full_windows(W.chunk_runs(runs, S, 2), ["s", "run_id", "window_no"], 2, F.min("tick_t").alias("t")).collect()
    assert [(r.run_id, r.window_no, r.t) for r in windows] == [(0, 0, 0)]


def test_exact_join_repeats_rows_for_repeated_labels_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 5), (1, 6)], "s int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b")], "s int, t int, y string")
    got = sorted((r.t, r.y or "") for r in J.join_labels_exact(left, right, ["s", "t"]).collect())
    assert got == [(5, "a"), (5, "b"), (6, "")]


def test_zip_reports_lengths(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "s int, t bigint")
    b = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "s int, u bigint")
    zipped = J.zip_rows(a, b, (Stream(("s",), "t", (), 5), Stream(("s",), "u", (), 5)))
    assert sorted((r.s, r.seq, r.t, r.u) for r in zipped.collect()) == [(1, 0, 0, 5), (2, 0, 0, 6)]
    assert sorted(map(tuple, J.length_mismatches(a, b, ["s"]).collect())) == [(1, 2, 1), (3, 0, 1)]


def test_decode_writes_unknown_ids_as_text(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,), (None,)], "y int")
    assert [r["name"] for r in J.decode_labels(df, ["sit", "walk"], "y").orderBy("y").collect()] == [None, "-1", "sit", "walk", "2"]
