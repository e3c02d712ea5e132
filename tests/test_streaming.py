from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stridelake.streaming import live as S

LINES = """time_ms,left_accel_x,left_accel_y
12,1.5,2.5

-3,4.5,oops
garbage,1,2
15,7.5
 20,8.5,9.5
"""


def drain(spark, df, tmp_path, name="out"):
    S.run_to_files(df, f"{tmp_path}/{name}/rows", f"{tmp_path}/{name}/progress").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}/rows")


def test_ingest_keeps_lines_that_begin_with_a_number(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.csv").write_text(LINES)
    df = S.stream_samples(spark, f"{tmp_path}/in", "time_ms bigint, a double, b double")
    rows = sorted(map(tuple, drain(spark, df, tmp_path).collect()), key=str)
    assert rows == sorted([(12, 1.5, 2.5), (-3, 4.5, None), (15, 7.5, None), (20, 8.5, 9.5)], key=str)


def test_default_columns_are_those_of_the_two_sensor_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.csv").write_text(",".join(str(float(i)) for i in range(13)) + "\n")
    row = drain(spark, S.stream_samples(spark, f"{tmp_path}/in"), tmp_path).first()
    assert row.time_ms == 0.0 and row.left_accel_x == 1.0 and row.right_gyro_z == 12.0


def feed(spark, tmp_path, batches, schema="s int, i bigint, x double"):
    """A file stream that sees one batch per trigger."""
    folder = tmp_path / "feed"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={k}"))
    return (
        spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("part")
    )


@pytest.mark.parametrize("size,hop", [(3, 3), (3, 1), (2, 5)])
def test_windows_continue_over_triggers(spark, tmp_path, size, hop):
    # The recording arrives in pieces, shuffled inside each.
    pieces = [[1, 0], [3, 2, 5, 4], [6], [8, 7, 10, 9]]
    df = feed(spark, tmp_path, [[(1, i, i / 2) for i in piece] for piece in pieces])
    rows = drain(spark, S.stream_windows(df, "s", "i", ["x"], size, hop), tmp_path).orderBy("window_no").collect()
    starts = list(range(0, 11 - size + 1, hop))
    assert [(r.window_no, r.first_order, r.late_rows) for r in rows] == [(k, a, 0) for k, a in enumerate(starts)]
    assert [r.data for r in rows] == [[[(a + j) / 2] for j in range(size)] for a in starts]


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    df = feed(spark, tmp_path, [[(1, 0, 0.0), (1, 4, 4.0)], [(1, 2, 2.0), (1, 5, 5.0), (1, 6, 6.0)]])
    rows = drain(spark, S.stream_windows(df, "s", "i", ["x"], 2, 2), tmp_path).orderBy("window_no").collect()
    assert [(r.first_order, r.late_rows, r.data) for r in rows] == [(0, 0, [[0.0], [4.0]]), (5, 1, [[5.0], [6.0]])]


def test_rows_of_equal_order_are_kept_over_triggers(spark, tmp_path):
    df = feed(spark, tmp_path, [[(1, 0, 0.0), (1, 4, 9.0), (1, 4, 4.0)], [(1, 4, 5.0), (1, 6, 6.0), (1, 6, 2.0)]])
    rows = drain(spark, S.stream_windows(df, "s", "i", ["x"], 2, 2, ties=["x"]), tmp_path).orderBy("window_no").collect()
    assert [(r.first_order, r.late_rows, r.data) for r in rows] == [(0, 0, [[0.0], [4.0]]), (4, 0, [[9.0], [5.0]]), (6, 0, [[2.0], [6.0]])]


def test_late_rows_are_counted_without_a_next_window(spark, tmp_path):
    df = feed(spark, tmp_path, [[(1, 0, 0.0), (1, 4, 4.0)], [(1, 2, 2.0), (1, 3, 3.0)], [(1, 1, 1.0), (1, 7, 7.0)]])
    rows = drain(spark, S.stream_windows(df, "s", "i", ["x"], 2, 2), tmp_path).orderBy("late_rows").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0, [[0.0], [4.0]]), (1, None, None, 1, None), (1, None, None, 2, None)]


def test_rows_behind_the_watermark_are_dropped_from_buckets(spark, tmp_path):
    schema = "s int, at bigint, x double"
    df = feed(spark, tmp_path, [[(1, 0, 1.0), (1, 100, 2.0)], [(1, 101, 4.0)], [(1, 1, 9.0), (1, 300, 5.0)], [(1, 600, 5.0)]], schema)
    timed = df.withColumn("ts", F.timestamp_seconds("at"))
    out = drain(spark, S.stream_resample(timed, ["s"], "ts", ["x"], "10 seconds", "20 seconds"), tmp_path)
    got = sorted((r.bucket_start.timestamp(), r.n_rows, r.x) for r in out.collect())
    assert got == [(0.0, 1, 1.0), (100.0, 2, 3.0), (300.0, 1, 5.0)]


def test_a_wall_clock_time_is_refused(spark):
    df = spark.sql("select 1 as s, timestamp_ntz'2024-01-01 00:00:00' as ts, 1D as x")
    with pytest.raises(ValueError, match="time zone"):
        S.stream_resample(df, ["s"], "ts", ["x"], "1 second", "1 second")


def test_sessions_split_at_the_gap(spark, tmp_path):
    schema = "s int, at bigint"
    df = feed(spark, tmp_path, [[(1, 0), (1, 9), (1, 19)], [(1, 500)], [(1, 900)]], schema)
    timed = df.withColumn("ts", F.timestamp_seconds("at"))
    out = drain(spark, S.stream_sessions(timed, ["s"], "ts", 10_000_000, "5 seconds"), tmp_path)
    got = sorted((r.n_rows, r.first_time.timestamp(), r.last_time.timestamp()) for r in out.collect())
    assert got == [(1, 19.0, 19.0), (1, 500.0, 500.0), (2, 0.0, 9.0)]


@pytest.mark.parametrize("size,hop", [(3, 3), (3, 1), (2, 5)])
def test_numbered_windows_fill_in_any_order(spark, tmp_path, size, hop):
    pieces = [[10, 0, 4], [3, 2, 9, 5], [1, 6], [8, 7]]
    df = feed(spark, tmp_path, [[(1, i, i / 2) for i in piece] for piece in pieces])
    out = S.stream_windows_numbered(df, "s", "i", ["x"], size, hop)
    rows = drain(spark, out, tmp_path).orderBy("window_no").collect()
    assert [(r.window_no, r.data) for r in rows] == [
        (k, [[(a + j) / 2] for j in range(size)]) for k, a in enumerate(range(0, 11 - size + 1, hop))
    ]


def test_a_window_that_lost_a_row_is_forgotten(spark, tmp_path):
    """Row 1 comes after the state of its window went; its window stays unfinished."""
    schema = "s int, i bigint, x double, at bigint"
    batches = [[(1, 0, 0.0, 0)], [(1, 2, 2.0, 100)], [(1, 3, 3.0, 200)], [(1, 1, 1.0, 201)], [(1, 4, 4.0, 300)]]
    df = feed(spark, tmp_path, batches, schema).withColumn("ts", F.timestamp_seconds("at"))
    out = S.stream_windows_numbered(df, "s", "i", ["x"], 2, 2, time="ts", forget_after_ms=150_000)
    assert [(r.window_no, r.data) for r in drain(spark, out, tmp_path).collect()] == [(1, [[2.0], [3.0]])]


def test_tabs_may_separate(spark):
    lines = spark.createDataFrame([("1\t2.5",), ("-3\t4\r",), ("head\tline",)], "value string")
    got = [tuple(r) for r in S.parse_lines(lines, "a double, b double", sep="\t").collect()]
    assert got == [(1.0, 2.5), (-3.0, 4.0)]


def test_repeated_rows_fill_a_numbered_window_once(spark, tmp_path):
    """Rows 0, 0, 1, 2 are one window of three, whether the repeat comes in the same trigger or in a later one."""
    for k, batches in enumerate(([[(1, 0, 0.0), (1, 0, 9.0), (1, 1, 1.0), (1, 2, 2.0)]], [[(1, 0, 0.0)], [(1, 0, 9.0)], [(1, 1, 1.0)], [(1, 2, 2.0)]])):
        home = tmp_path / str(k)
        home.mkdir()
        out = S.stream_windows_numbered(feed(spark, home, batches), "s", "i", ["x"], 3, 3)
        assert [(r.window_no, r.data) for r in drain(spark, out, home).collect()] == [(0, [[0.0], [1.0], [2.0]])]


@pytest.mark.parametrize("size,hop", [(4, 4), (5, 2), (2, 5), (7, 1)])
def test_windows_of_a_block_share_a_state(spark, tmp_path, monkeypatch, size, hop):
    """Odd numbers come first, some of them again with the even ones: a state is kept per block, not per window."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 10 * size)
    rows = [(s, i, s * 1000 + i / 2) for s in (1, 2) for i in range(400)]
    early, late = [r for r in rows if r[1] % 2], [r for r in rows if r[1] % 2 == 0]
    df = feed(spark, tmp_path, [early, [(s, i, -1.0) for s, i, _ in early[:50]] + late[::-1]])
    query = S.run_to_files(S.stream_windows_numbered(df, "s", "i", ["x"], size, hop), f"{tmp_path}/rows", f"{tmp_path}/progress")
    query.awaitTermination()
    starts = range(0, 400 - size + 1, hop)
    want = {(s, k): [[s * 1000 + (a + j) / 2] for j in range(size)] for s in (1, 2) for k, a in enumerate(starts)}
    found = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert {(r.s, r.window_no): r.data for r in found} == want and len(found) == len(want)
    states = query.recentProgress[0]["stateOperators"][0]["numRowsTotal"]
    assert 0 < states <= 2 * (-(-(399 // hop + 1) // 10))


def test_windows_of_a_block_are_forgotten_one_by_one(spark, tmp_path):
    """Windows 0 and 1 share a state; window 0 is forgotten while window 1 still gets rows."""
    schema = "s int, i bigint, x double, at bigint"
    batches = [[(1, 0, 0.0, 1), (1, 3, 3.0, 1)], [(1, 4, 4.0, 200)], [(1, 4, 9.0, 201)], [(1, 1, 1.0, 210), (1, 2, 2.0, 210), (1, 5, 5.0, 210)]]
    df = feed(spark, tmp_path, batches, schema).withColumn("ts", F.timestamp_seconds("at"))
    out = S.stream_windows_numbered(df, "s", "i", ["x"], 3, 3, time="ts", forget_after_ms=150_000)
    assert [(r.window_no, r.data) for r in drain(spark, out, tmp_path).collect()] == [(1, [[3.0], [4.0], [5.0]])]


def test_recordings_without_a_name_and_large_keys_share_no_state(spark, tmp_path):
    """Keys beyond 2^53 keep their digits beside rows without a key, which are one recording."""
    big = (1 << 60) + 1
    rows = [(s, i, float(i)) for s in (big, big + 1, None, 5) for i in range(6)]
    df = feed(spark, tmp_path, [rows[:3] + rows[7:], rows[3:7]], "s bigint, i bigint, x double")
    out = drain(spark, S.stream_windows_numbered(df, "s", "i", ["x"], 3, 3), tmp_path).collect()
    want = {(s, k, (3.0 * k, 3.0 * k + 1, 3.0 * k + 2)) for s in (big, big + 1, None, 5) for k in (0, 1)}
    assert {(r.s, r.window_no, tuple(x for x, in r.data)) for r in out} == want and len(out) == 8


def test_short_recordings_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 8)
    rows = [(s, i, float(s)) for s in range(100) for i in range(5)]
    query = S.run_to_files(S.stream_windows_numbered(feed(spark, tmp_path, [rows]), "s", "i", ["x"], 4, 2), f"{tmp_path}/rows", f"{tmp_path}/progress")
    query.awaitTermination()
    assert sorted((r.s, r.window_no, r.data) for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [(s, 0, [[float(s)]] * 4) for s in range(100)]
    assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 8
