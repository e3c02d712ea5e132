from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.operators import fusion
from stridelake.operators.ordered import with_running
from stridelake.operators.windows import chunk_runs, full_windows

WIDTH = 10


def recording(rng, kind):
    """Rows (time, label, value) of two sensors in file order."""
    sensors = []
    for _ in range(2):
        t, rows = rng.randrange(20), []
        for _ in range(rng.choice([0, 1, 40, 120])):
            pause = kind == "pauses" and rng.random() < 0.05
            t += rng.randrange(100) if pause else rng.randrange(1, 7 if kind == "dense" else 14)
            label = None if rng.random() < 0.01 else "ab"[t // 90 % 2]
            rows.append((t, label, float(rng.randrange(100))))
        if kind == "back":  # times go back a little, and now and then far
            rows.sort(key=lambda r: r[0] + rng.randrange(-8, 8) + (rng.random() < 0.03) * 60)
        sensors.append(rows)
    return sensors


def scanned(sensors, width=WIDTH):
    """The rule of the scan, one row at a time."""
    out, at, tag, fresh = [], [0, 0], None, True
    while all(a < len(s) for a, s in zip(at, sensors)):
        if tag is None:
            tag, fresh = min(s[a][0] for a, s in zip(at, sensors)), True
        begin = list(at)
        for i, s in enumerate(sensors):
            while at[i] < len(s) and abs(s[at[i]][0] - tag) < width:
                at[i] += 1
        taken = [s[b:a] for s, b, a in zip(sensors, begin, at)]
        labels = {r[1] for rows in taken for r in rows}
        if all(taken) and len(labels) == 1 and None not in labels:
            out.append((tag, fresh, *[sum(r[2] for r in rows) / len(rows) for rows in taken]))
            tag, fresh = tag + width, False
        else:
            tag = None
    return out


@pytest.mark.parametrize("slice_width", [1_000_000, 7])
@pytest.mark.parametrize("by_row", [False, True])
def test_ticks_are_those_of_the_scan_whatever_the_slices(spark, slice_width, by_row, monkeypatch):
    monkeypatch.setattr(fusion, "ROWS_PER_SLICE", slice_width)
    rng = random.Random(8)
    recordings = {k: recording(rng, kind) for k, kind in enumerate(["dense", "pauses", "back"] * 12)}
    if not by_row:
        recordings = {k: [sorted(s, key=lambda r: r[0]) for s in sensors] for k, sensors in recordings.items()}
    schema = "k long, row long, t long, label string, x double, fresh int, _k int, tick_t int"
    first, second = (spark.createDataFrame([(k, i, *r, 0, 0, 0) for k, s in recordings.items() for i, r in enumerate(s[side])] + [(None, 0, 1, "a", 1.0, 0, 0, 0), (0, 900, None, "a", 1.0, 0, 0, 0)], schema)
                     for side in (0, 1))
    stream = Stream(("k",), "t", ("row",), slice_width)
    ticks = fusion.fuse_sequential(first, second, stream, ["x"], "label", WIDTH, row="row" if by_row else None)
    assert ticks.columns == ["k", "tick_t", "label", "fresh", "first_row", "acc_x", "gyro_x"]
    found = {}
    for r in ticks.orderBy("k", "first_row").collect():
        found.setdefault(r.k, []).append((r.tick_t, r.fresh, r.acc_x, r.gyro_x))
    want = {k: scanned(s) for k, s in recordings.items()}
    assert found == {k: v for k, v in want.items() if v} and sum(map(len, found.values())) > 200


def test_blocks_double_where_slices_do_not_agree(spark, monkeypatch):
    """A label change shifts every later tag of an unbroken recording: the assumed state is wrong in all slices after it."""
    rows = [[(0, t, "a" if t < 33 else "b", float(t)) for t in range(s, 3000, 3)] for s in (0, 1)]
    first, second = (spark.createDataFrame(r, "k long, t long, label string, x double") for r in rows)
    rounds = []
    scan = fusion._scanned
    monkeypatch.setattr(fusion, "_scanned", lambda *a, **b: rounds.append(b.get("size", a[-1])) or scan(*a, **b))
    ticks = fusion.fuse_sequential(first, second, Stream(("k",), "t", (), 60), ["x"], "label", WIDTH)
    want = scanned([[(t, l, x) for _, t, l, x in r] for r in rows])
    assert sorted((r.tick_t, r.fresh, r.acc_x, r.gyro_x) for r in ticks.collect()) == want
    assert len(want) > 200 and rounds[0] == 1 and rounds[-1] == 1 and rounds[1:-1] == [2 << i for i in range(len(rounds) - 2)] and len(rounds) <= 8


def test_windows_of_unbroken_ticks(spark):
    rows = [[(0, t, "a" if t < 105 else "b", float(t)) for t in range(s, 400, 3)] for s in (0, 1)]
    first, second = (spark.createDataFrame(r, "k long, t long, label string, x double") for r in rows)
    stream = Stream(("k",), "t", (), 60)
    ticks = fusion.fuse_sequential(first, second, stream, ["x"], "label", WIDTH)
    cut = full_windows(chunk_runs(fusion.fused_runs(ticks, stream), stream, 4), ["k", "run_id", "window_no"], 4, F.min("tick_t").alias("t"))
    runs = []
    for tag, fresh, *_ in scanned([[r[1:] for r in s] for s in rows]):
        if fresh:
            runs.append([])
        runs[-1].append(tag)
    want = [run[i] for run in runs for i in range(0, len(run) - 3, 4)]
    assert sorted(r.t for r in cut.collect()) == want


def test_empty_and_missing(spark):
    schema = "k long, t long, label string, x double"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, 5, "a", 1.0)], schema)
    stream = Stream(("k",), "t")
    assert fusion.fuse_sequential(none, some, stream, ["x"], "label", 10).collect() == []
    assert [tuple(r) for r in fusion.fuse_sequential(some, some, stream, ["x"], "label", 10).collect()] == [(1, 5, "a", True, 5, 1.0, 1.0)]
    with pytest.raises(ValueError, match="missing"):
        fusion.fuse_sequential(none.drop("x"), some, stream, ["x"], "label", 10)
    with pytest.raises(ValueError, match="positive"):
        fusion.fuse_sequential(none, some, stream, ["x"], "label", 0)


@pytest.mark.parametrize("slice_width", [3, 1000])
def test_running_values_cross_slices(spark, slice_width):
    rng = random.Random(2)
    rows = [(k, t, rng.randrange(100)) for k in range(3) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, t long, v int")
    stream = Stream(("k",), "t", (), slice_width)
    up = with_running(df, stream, {"most": (F.max, "v"), "least": (F.min, "v")})
    down = with_running(up, stream, {"after": (F.min, "v")}, backwards=True, before=True)
    for r in down.collect():
        own = [v for k, t, v in rows if k == r.k and t <= r.t]
        rest = [v for k, t, v in rows if k == r.k and t > r.t]
        assert (r.most, r.least, r.after) == (max(own), min(own), min(rest, default=None))


def test_slices_of_a_batch_are_scanned_together(spark, monkeypatch):
    """A result per batch, not per slice, whose overhead is that of many rows; a slice may need many batches."""
    rows = [[(k, t, "a", float(t)) for k in range(40) for t in range(s, 200, 3)] for s in (0, 1)]
    first, second = (spark.createDataFrame(r, "k long, t long, label string, x double") for r in rows)
    want = scanned([[r[1:] for r in s if r[0] == 0] for s in rows])
    made, map_in_arrow = [], type(first).mapInArrow

    def counted(df, scan, schema):
        table = df.toArrow().combine_chunks()
        for size in (7, 10_000):
            batches = table.to_batches(max_chunksize=size)
            results = list(scan(iter(batches)))
            made.append((size, len(results), len(batches), sum(r.num_rows for r in results)))
        return map_in_arrow(df, scan, schema)

    monkeypatch.setattr(type(first), "mapInArrow", counted)
    ticks = fusion.fuse_sequential(first, second, Stream(("k",), "t", (), 10), ["x"], "label", WIDTH)
    got = {}
    for r in ticks.orderBy("k", "tick_t").collect():
        got.setdefault(r.k, []).append((r.tick_t, r.fresh, r.acc_x, r.gyro_x))
    assert got == {k: want for k in range(40)}
    assert made and all(results <= batches + 1 for _, results, batches, _ in made)
    assert all(small[3] == large[3] for small, large in zip(made[::2], made[1::2]))
