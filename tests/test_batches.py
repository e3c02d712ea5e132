from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.streaming import batches as B
from stridelake.streaming import live as S

SCHEMA = "s long, t long, i long, x double, n long"
STREAM = Stream(("s",), "t", ("i",), 5)


def expected(parts, size, hop):
    """Windows and late rows by the rule, one recording and row at a time."""
    taken, late = {}, []
    for rows in parts:
        for s in {r[0] for r in rows if r[0] is not None}:
            own = taken.setdefault(s, [])
            last = own[-1][1] if own else None
            for r in sorted((r for r in rows if r[0] == s and r[1] is not None), key=lambda r: r[1:3]):
                (late if last is not None and r[1] < last else own).append(r)
        late += [r for r in rows if r[0] is None or r[1] is None]
    windows = {(s, w): (own[w * hop][1], [[r[3]] for r in own[w * hop : w * hop + size]])
               for s, own in taken.items() for w in range(max(0, (len(own) - size) // hop + 1))}
    return windows, sorted(late, key=str)


def parts_of(seed, n=3):
    rng = random.Random(seed)
    parts, i = [], 0
    for k in range(n):
        rows = []
        for _ in range(rng.choice([0, 8, 30]) if k % 2 else 30):
            i += 1
            rows.append((rng.randrange(3), rng.randrange(k * 10 - 4, k * 10 + 14), i, float(i), 7))
        parts.append(rows + ([(None, 1, 1000 + k, 0.0, 7), (1, None, 2000 + k, 0.0, 7)] if k == 2 else []))
    return parts


def deliver(spark, home, parts, size, hop, stop=None):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{home}/in")
        feed = spark.readStream.schema(SCHEMA).parquet(f"{home}/in")
        query = B.windows_by_arrival(feed, f"{home}/out", f"{home}/progress", STREAM, ["x"], size, hop, then=stop and stop(k))
        query.awaitTermination()


def results(spark, home):
    windows = B.all_batches(spark, f"{home}/out", "windows", "s long, window_no long, first_order long, data array<array<double>>")
    late = B.all_batches(spark, f"{home}/out", "late", "s long, t long, i long, x double")
    found = [((r.s, r.window_no), (r.first_order, r.data)) for r in windows.collect()]
    assert len(found) == len(dict(found))
    return dict(found), sorted((tuple(r) for r in late.collect()), key=str)


@pytest.mark.parametrize("size,hop,seed", [(3, 1, 1), (4, 4, 2), (2, 5, 3)])
def test_windows_and_late_rows_over_runs(spark, tmp_path, size, hop, seed):
    parts = parts_of(seed)
    deliver(spark, tmp_path, parts, size, hop)
    windows, late = expected(parts, size, hop)
    assert results(spark, tmp_path) == (windows, sorted([r[:4] for r in late], key=str)) and windows and late


def test_a_failed_batch_runs_again_to_the_same_rows(spark, tmp_path):
    """A batch that fails once windows are to be written has its earlier tables; the next run finishes it."""
    parts = parts_of(4)

    def broken(windows):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        deliver(spark, tmp_path, parts[:2], 3, 2, stop=lambda k: broken if k == 1 else None)
    assert B.BatchTables(spark, f"{tmp_path}/out").has("counted", 1)
    feed = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    B.windows_by_arrival(feed, f"{tmp_path}/out", f"{tmp_path}/progress", STREAM, ["x"], 3, 2).awaitTermination()
    deliver(spark, tmp_path, parts[2:], 3, 2)
    windows, late = expected(parts, 3, 2)
    assert results(spark, tmp_path) == (windows, sorted([r[:4] for r in late], key=str))


def test_a_batch_that_was_not_acknowledged_adds_nothing(spark, tmp_path):
    """Without the acknowledgement in the checkpoint, the stream hands the last batch out again."""
    parts = parts_of(5)
    deliver(spark, tmp_path, parts, 3, 3)
    before = results(spark, tmp_path)
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)
    deliver(spark, tmp_path, [[]], 3, 3)
    assert results(spark, tmp_path) == before


def test_no_task_holds_a_recording(spark, tmp_path):
    """One recording, one batch: the widest group that is sorted or gathered is a slice."""
    rows = [(1, t, t, float(t), 0) for t in range(400)]
    deliver(spark, tmp_path, [rows], 4, 4)
    windows, _ = results(spark, tmp_path)
    assert windows == expected([rows], 4, 4)[0]
    from stridelake.operators.ordered import number_rows

    plan = number_rows(spark.createDataFrame(rows, SCHEMA), STREAM)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s" in plan and "_slice" in plan.split("hashpartitioning(s", 1)[1][:60]


def test_every_row_is_in_time_or_late(spark, tmp_path):
    parts = [[(1, 0), (1, 100), (2, 95)], [(1, 81), (1, 69), (2, 70), (2, 300), (3, None)], [(1, 275), (3, 279), (3, 280), (1, 900)]]
    for rows in parts:
        spark.createDataFrame(rows, "s int, at bigint").write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema("s int, at bigint").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("at"))
        B.admit(feed, f"{tmp_path}/out", f"{tmp_path}/progress", "ts", B.bucket_closes("ts", "10 seconds"), "20 seconds").awaitTermination()
    in_time, late = (B.all_batches(spark, f"{tmp_path}/out", name, feed.schema) for name in ("accepted", "late"))
    # Watermarks 80 and 280 before the second and the third run: buckets that end there or earlier are closed.
    assert sorted((r.s, r["at"]) for r in late.where("at is not null").collect()) == [(1, 69), (1, 275), (2, 70), (3, 279)] and late.where("at is null").count() == 1
    assert in_time.count() + late.count() == sum(map(len, parts))
    end = S.end_of_feed(feed_batch := spark.read.schema("s int, at bigint").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("at")), "ts", "1 day")
    end.write.parquet(f"{tmp_path}/out/accepted/batch=99")
    buckets = S.stream_resample(B.accepted(spark, f"{tmp_path}/out", feed.schema).withColumn("x", F.lit(1.0)), ["s"], "ts", ["x"], "10 seconds", "20 seconds")
    S.run_to_files(buckets, f"{tmp_path}/rows", f"{tmp_path}/done").awaitTermination()
    counted = spark.read.schema(buckets.schema).parquet(f"{tmp_path}/rows").agg(F.sum("n_rows")).first()[0]
    assert counted == in_time.count() and feed_batch.count() == sum(map(len, parts))
