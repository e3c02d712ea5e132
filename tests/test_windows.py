from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.operators import windows as W

S = Stream(("s",), "t", (), 6)


def series(spark, *lengths):
    return spark.createDataFrame([(s, t) for s, n in enumerate(lengths) for t in range(n)], "s int, t bigint")


@pytest.mark.parametrize("size,hop", [(4, 1), (4, 2), (4, 4), (4, 7), (1, 1), (5, 3)])
def test_sliding_windows_cover_what_a_loop_covers(spark, size, hop):
    lengths = (3, 4, 5, 9, 23)
    got = {(r.s, r.window_no, r.step, r.t, r.start_seq) for r in W.sliding_windows(series(spark, *lengths), S, size, hop).collect()}
    want = {
        (s, w, step, start + step, start)
        for s, n in enumerate(lengths)
        for w, start in enumerate(range(0, n - size + 1, hop))
        for step in range(size)
    }
    assert got == want


def test_tumbling_windows_at_exactly_one_window(spark):
    df = series(spark, 3, 4, 5, 9)
    assert {r.s for r in W.tumbling_windows(df, S, 4).select("s").distinct().collect()} == {1, 2, 3}
    assert {r.s for r in W.tumbling_windows(df, S, 4, min_rows=5).select("s").distinct().collect()} == {2, 3}


def test_sizes_must_be_positive(spark):
    with pytest.raises(ValueError):
        W.sliding_windows(series(spark, 3), S, 0, 1)
    with pytest.raises(ValueError):
        W.sliding_windows(series(spark, 3), S, 2, 0)


def test_gap_of_exactly_the_threshold_starts_a_run(spark):
    times = [0, 149, 299, 450]  # steps 149, 150, 151
    df = spark.createDataFrame([(1, t) for t in times], "s int, t bigint")
    rows = W.gap_sessions(df, Stream(("s",), "t", (), 100), 150).orderBy("t").collect()
    assert [r.run_id for r in rows] == [0, 0, 1, 2]
    assert [r.run_pos for r in rows] == [0, 1, 0, 0]


def test_contiguous_windows_stay_in_one_run_with_one_label(spark):
    rows = [(1, t, y) for t, y in [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (20, 2), (21, 2), (22, 2)]]
    df = spark.createDataFrame(rows, "s int, t bigint, y int")
    got = W.contiguous_windows(df, Stream(("s",), "t", (), 4), size=2, hop=2, gap=5, label="y").orderBy("window_no").collect()
    assert [(r.window_no, r.start_t, r.end_t, r.y) for r in got] == [(0, 0, 1, 0), (2, 4, 5, 1), (3, 20, 21, 1)]


LABELS = [[0, 0], [0, 3], [2, 3], [0, 2, 3], [-1, 3], [-2, -1]]


@pytest.mark.parametrize(
    "mode,expected",
    [("all", {0: 0}), ("any", {0: 0, 1: 3, 2: 3, 3: 2, 4: 3, 5: 0}), ("first", {0: 0, 1: 0, 2: 2, 3: 0, 4: -1, 5: -2})],
)
def test_label_merge(spark, mode, expected):
    long = spark.createDataFrame([(w, i, y) for w, ys in enumerate(LABELS) for i, y in enumerate(ys)], "w int, step int, y int")
    assert {r.w: r.y for r in W.merge_window_labels(long, ["w"], "y", mode).collect()} == expected


def test_label_merge_can_mark_instead_of_leaving_out(spark):
    long = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)], "w int, step int, y int")
    assert {r.w: r.same for r in W.merge_window_labels(long, ["w"], "y", "all", flag="same").collect()} == {0: True, 1: False}


def test_subwindows_keep_order_and_refuse_a_misfit(spark):
    long = spark.createDataFrame([(w, i) for w in range(2) for i in range(6)], "w bigint, step int")
    got = sorted((r.piece_id, r.step, r.w) for r in W.subwindows(long, "w", 6, 3).collect())
    assert got == [(p, i, p // 2) for p in range(4) for i in range(3)]
    with pytest.raises(ValueError):
        W.subwindows(long, "w", 6, 4)


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_chunks_stay_inside_runs(spark, overlap):
    df = spark.createDataFrame([(1, t) for t in [0, 1, 2, 3, 4, 5, 6, 50, 51, 52, 53, 90]], "s int, t bigint")
    stream = Stream(("s",), "t", (), 8)
    chunks = W.chunk_runs(W.gap_sessions(df, stream, 10), stream, 4, overlap)
    got = W.full_windows(chunks, ["s", "run_id", "window_no"], 4, F.min("t").alias("a"), F.max("t").alias("b")).collect()
    want = [(start, start + 3) for start in range(0, 7 - 3, 4 - overlap)] + [(50, 53)]
    assert sorted((r.a, r.b) for r in got) == want


def test_first_run_and_activity_runs(spark):
    df = spark.createDataFrame([(1, t, y) for t, y in enumerate("abbbaabb")], "s int, t bigint, y string")
    stream = Stream(("s",), "t", (), 3)
    runs = sorted((r.start_seq, r.end_seq, r.y) for r in W.activity_runs(df, stream, "y").collect())
    assert runs == [(0, 1, "a"), (1, 4, "b"), (4, 6, "a"), (6, 8, "b")]
    assert [(r.start_seq, r.end_seq) for r in W.first_run(df, stream, "y", "b").collect()] == [(1, 4)]
    assert W.first_run(df, stream, "y", "z").count() == 0


def test_assembled_windows_are_in_step_order(spark):
    long = W.tumbling_windows(series(spark, 8).repartition(5), S, 4)
    rows = W.assemble_windows(long.withColumn("x", F.col("t") * 2), ["s", "window_no"], ["t", "x"]).orderBy("window_no").collect()
    assert rows[1].data == [[4.0, 8.0], [5.0, 10.0], [6.0, 12.0], [7.0, 14.0]]
