"""Rate changes against step-by-step restatements on small recordings."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.operators import ordered as O
from stridelake.operators import resample as R

S = Stream(("s",), "t", ("i",), 7)


def recordings(spark, lists):
    """Rows (s, i, t, v) of lists of times; the value repeats the row number."""
    rows = [(s, i, t, float(i)) for s, times in enumerate(lists) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "s int, i int, t bigint, v double")


def blocks(n, p, q, guard):
    """Row ranges of blocks by walking the recording."""
    if p % q == 0:
        r = p // q
        return [range(i, min(i + r, n)) for i in range(0, n, r)]
    out, k = [], 0
    while True:
        start, end = k * p // q, (k + 1) * p // q
        limit = start + p // q + 1
        if not (limit < n if guard == "lt" else limit <= n):
            return out
        out.append(range(start, end))
        k += 1


@pytest.mark.parametrize("p,q,guard", [(5, 2, "lt"), (5, 2, "le"), (3, 1, "lt"), (37, 5, "lt"), (10001, 10000, "le"), (1, 1, "lt")])
def test_block_mean_walks_like_a_loop(spark, p, q, guard):
    lengths = list(range(0, 13)) + [40]
    df = recordings(spark, [list(range(n)) for n in lengths])
    got = {(r.s, r.block): (r.n_rows, r.v) for r in R.block_mean(df, S, ["v"], p, q, guard=guard).collect()}
    want = {
        (s, k): (len(b), statistics.fmean(b)) for s, n in enumerate(lengths) for k, b in enumerate(blocks(n, p, q, guard))
    }
    assert got.keys() == want.keys()
    for key, (rows, mean) in want.items():
        assert got[key][0] == rows and math.isclose(got[key][1], mean)


@pytest.mark.parametrize("n,expected", [(6, 1), (7, 2), (8, 2), (3, 0), (9, 2), (10, 3)])
def test_segment_tail_drops_the_last_block_even_if_it_fits(spark, n, expected):
    df = recordings(spark, [list(range(n))])
    assert R.block_mean(df, S, ["v"], 3, tail="drop_last").count() == expected


def test_ratio_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        R.block_mean(recordings(spark, [[1]]), S, ["v"], 1, 2)


def nearest_rows(times, dt):
    """Indices of the rows that some grid point takes, the later one at half way."""
    once = [i for i, t in enumerate(times) if i == 0 or t > times[i - 1]]
    if len(once) < 2:
        return set()
    t0, t1 = times[once[0]], times[once[-1]]
    kept, g = set(), 0
    while t0 + g * dt < t1 + dt / 2:
        point = t0 + g * dt
        kept.add(min(once, key=lambda i: (abs(times[i] - point), -times[i])))
        g += 1
    return kept


def test_nearest_grid_matches_a_search_per_grid_point(spark):
    rng = random.Random(3)
    lists = [[0, 10, 20, 30], [0, 5, 10], [0, 0, 4, 4, 9], [3], [0, 100], [5, 5]]
    lists += [sorted(rng.choices(range(60), k=rng.randint(2, 20))) for _ in range(60)]
    df = recordings(spark, lists)
    for step in (4, 10):
        got = {(r.s, r.i) for r in R.resample_nearest(df, S, step=step).collect()}
        assert got == {(s, i) for s, times in enumerate(lists) for i in nearest_rows(times, step)}


def test_keep_increasing_compares_with_the_row_before_kept_or_not(spark):
    df = recordings(spark, [[1, 5, 3, 4, 4, 6]])
    by_file = Stream(("s",), "i", (), 2)
    kept = R.keep_increasing(df.withColumn("i", F.col("i").cast("bigint")), by_file, "t")
    assert sorted(r.t for r in kept.collect()) == [1, 4, 5, 6]


def test_dedup_keeps_the_first_of_a_time(spark):
    kept = R.dedup_times(recordings(spark, [[1, 1, 2, 2, 2, 9]]), S).collect()
    assert sorted((r.t, r.i) for r in kept) == [(1, 0), (2, 2), (9, 5)]


def test_rate_is_one_over_the_median_positive_step(spark):
    lists = [[0, 1, 3, 6], [0, 1, 3, 6, 10], [0, 0, 0], [5], [0, 0, 4, 4, 10]]
    got = {r.s: r.rate_hz for r in R.infer_rate(recordings(spark, lists), S, units_per_second=1, bucket=2).collect()}
    for s, times in enumerate(lists):
        steps = [b - a for a, b in zip(times, times[1:]) if b > a]
        assert math.isclose(got[s], 1 / statistics.median(steps) if steps else 0.0)


def test_rows_without_identity_or_time_have_no_step(spark):
    schema = "s int, t bigint, i int, v double"
    rows = [(0, 0, 0, 0.0), (0, None, 1, 1.0), (0, 4, 2, 2.0), (0, 24, 3, 3.0), (None, 5, 4, 4.0), (None, 6, 5, 5.0), (1, None, 6, 6.0)]
    df = spark.createDataFrame(rows, schema)
    assert [(r.s, r.median_dt) for r in R.infer_rate(df, S).collect()] == [(0, 12.0)]
    assert sorted((r.s, r.dt, r.times) for r in R.interval_counts(df, S).collect()) == [(0, 4, 1), (0, 20, 1)]
    out = R.downsample_if_needed(df, S, ["v"], hz_target=1.0, units_per_second=1).collect()
    assert sorted((r.s, r.block, r.v) for r in out) == [(0, 0, 0.0), (0, 1, 2.0), (0, 2, 3.0)]
    assert R.infer_rate(df.limit(0), S).collect() == []


def test_slow_recordings_are_left_as_they_are(spark):
    df = recordings(spark, [[0, 100, 200, 300], [0, 10, 20, 30, 40, 50, 60, 70]])
    out = R.downsample_if_needed(df, S, ["v"], hz_target=20.0, units_per_second=1000).collect()
    assert sorted((r.block, r.v) for r in out if r.s == 0) == [(k, float(k)) for k in range(4)]
    assert sorted((r.block, r.n_rows, r.t) for r in out if r.s == 1) == [(0, 5, 20), (1, 3, 60)]


def test_numbers_cross_empty_slices_and_odd_keys(spark):
    df = recordings(spark, [[-20, -8, -7, -1, 0, 6, 7, 700], [3]])
    got = {(r.s, r.i): (r.seq, r.n) for r in O.number_rows(df, S).collect()}
    assert got == {**{(0, i): (i, 8) for i in range(8)}, (1, 0): (0, 1)}


def test_neighbours_cross_slices(spark):
    df = recordings(spark, [[0, 6, 7, 30, 31], [9]])
    rows = sorted(O.with_neighbours(df, S, ["t", "v"]).collect(), key=lambda r: (r.s, r.i))
    assert [r.prev_t for r in rows] == [None, 0, 6, 7, 30, None]
    assert [r.next_v for r in rows] == [1.0, 2.0, 3.0, 4.0, None, None]


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_runs_do_not_depend_on_the_slice_width(spark, width):
    rng = random.Random(5)
    lists = [sorted(rng.sample(range(200), 40)) for _ in range(5)]
    stream = Stream(("s",), "t", ("i",), width)
    got = O.mark_runs(recordings(spark, lists), stream, lambda prev, cur: cur("t") - prev("t") >= 6).collect()
    want = {}
    for s, times in enumerate(lists):
        run, start = -1, 0
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] >= 6:
                run, start = run + 1, i
            want[s, i] = (run, start, times[start], i - start, i, len(times))
    assert {(r.s, r.i): (r.run_id, r.run_start, r.run_start_t, r.run_pos, r.seq, r.n) for r in got} == want
