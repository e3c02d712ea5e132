"""Plan shapes, hot recordings, and results that do not depend on partitioning."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import queries as registry
from stridelake import Stream
from stridelake.operators import joins as J
from stridelake.operators import ordered as O
from stridelake.operators import resample as R
from stridelake.operators import windows as W
from stridelake.stream import fit_slices

# Run over files or fitted models while they are built; their parts are covered elsewhere.
EAGER = {"m7_fit_classifier", "m8_select_best", "e8_pca_project", "e8_pca_variances", "q2_summarize_windows", "t8_prepare_event_windows"}
LAZY = sorted(n for n in registry.QUERIES if n not in EAGER and not re.match(r"[sx]\d", n))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_everything_with_everything(no_broadcast, folder, name):
    plan = plan_of(entry.queries()[name](no_broadcast, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Shuffles with automatic broadcasts off: the samples' own plus those of the slice summary.
SHUFFLES = {
    "r0_number_rows": 4, "r2_block_mean_fraction": 5, "r3_resample_nearest": 4, "r6_dedup_times": 1,
    "w1_sliding_windows": 4, "w2_tumbling_windows": 4, "w3_gap_sessions": 4, "j1_join_labels_exact": 2,
    "j3_join_nearest": 5, "f1_normalize_nine": 0, "f6_spectrum": 0, "m3_score_function": 0, "t2_split_fast": 0,
    "t7_take_random": 0, "w6_split_window_array": 0,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_number_of_shuffles(no_broadcast, folder, name):
    plan = plan_of(entry.queries()[name](no_broadcast, folder))
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan)) <= SHUFFLES[name]


@pytest.mark.parametrize("name, scans", [("r4_infer_rate", 1), ("r7_downsample_if_needed", 2)])
def test_rates_and_numbers_share_a_summary(no_broadcast, folder, name, scans):
    out = entry.queries()[name](no_broadcast, folder)
    out.collect()
    final = plan_of(out).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == scans


def test_scans_read_the_needed_columns_only(spark, folder):
    plan = plan_of(entry.queries()["r0_number_rows"](spark, folder))
    for columns in re.findall(r"ReadSchema: struct<([^>]*)", plan):
        assert set(re.findall(r"(\w+):", columns)) <= {"event_id", "ts", "user_id"}


HOT = Stream(("s",), "t", ("i",), 100)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 30,000 rows belong to one recording."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).cast("int").alias("s"),
        F.col("id").alias("i"), (F.col("id") * 3 + F.pmod(F.hash("id"), F.lit(3))).alias("t"),
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("int").alias("y"),
    )
    return rows.cache()


@pytest.mark.parametrize(
    "build",
    [
        lambda d: O.number_rows(d, HOT),
        lambda d: W.gap_sessions(d, HOT, 50),
        lambda d: R.resample_nearest(d, HOT, step=40),
        lambda d: J.join_nearest(d.filter("y > 0"), d.filter("y = 0").select("s", F.col("t").alias("lt"), "i", "x"), HOT, "lt", ["i"], ["x"]).drop("x"),
    ],
    ids=["number", "sessions", "grid", "nearest"],
)
def test_a_hot_recording_is_spread_over_tasks(spark, skewed, build):
    """No task of a sample-side window holds more than a few slices of the hot recording."""
    plan = plan_of(build(skewed))
    keyed_by_slice = re.findall(r"Exchange hashpartitioning\((s#\d+), (_slice#\d+L)", plan)
    assert keyed_by_slice
    sizes = HOT.sliced(skewed).groupBy(*HOT.slice_keys).count().agg(F.max("count")).first()[0]
    assert sizes <= 40


def test_a_burst_is_cut_into_many_slices(spark):
    """Half of one recording falls into a thousandth of its time; short recordings stay whole."""
    burst = spark.range(8000).select(
        F.lit(0).alias("s"), F.col("id").alias("i"),
        F.when(F.col("id") < 4000, F.col("id") * 1000).otherwise(F.col("id") - 4000).alias("t"),
    )
    short = spark.range(2000).select((F.col("id") % 50 + 1).cast("int").alias("s"), "id", (F.col("id") * 2).alias("t"))
    df = burst.unionByName(short.withColumnRenamed("id", "i"))
    fitted = fit_slices(df, HOT, max_rows=500)
    counts = fitted.sliced(df).groupBy(*fitted.slice_keys).count()
    assert counts.filter("s = 0").agg(F.max("count")).first()[0] <= 500
    assert counts.filter("s <> 0").count() == 50
    want = {(r.s, r.i): r.seq for r in O.number_rows(df, HOT).collect()}
    assert {(r.s, r.i): r.seq for r in O.number_rows(df, fitted).collect()} == want
    sessions = [sorted(map(tuple, W.gap_sessions(df, x, 700).collect())) for x in (HOT, fitted)]
    assert sessions[0] == sessions[1]


@pytest.mark.parametrize("times", [1, 3])
def test_a_recording_of_one_time_is_cut(spark, times):
    """Ties cut what the time cannot: no task gets more than a few hundred of 6,000 rows, and numbers are those of the order."""
    burst = spark.range(6000).select(F.lit(0).alias("s"), F.pmod(F.col("id") * 7919, F.lit(6000)).alias("i"), (F.col("id") % times + 5).alias("t"), (F.col("id") % 4).cast("int").alias("y"))
    short = spark.range(300).select((F.col("id") % 3 + 1).cast("int").alias("s"), F.col("id").alias("i"), F.lit(5).cast("bigint").alias("t"), F.lit(0).alias("y"))
    df = burst.unionByName(short)
    fitted = fit_slices(df, HOT, max_rows=400)
    placed = fitted.sliced(df)
    sizes = placed.filter("s = 0").groupBy("_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 400 and sizes.count() >= 15
    assert placed.filter("s <> 0").select("s", "_slice").distinct().count() == 3
    tasks = placed.repartition(64, *fitted.slice_keys).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks <= 1500  # some slices share one of the 64 tasks
    for build in (lambda x: O.number_rows(df, x), lambda x: W.gap_sessions(df, x, 1), lambda x: O.with_neighbours(df, x, ["t", "y"]), lambda x: W.activity_runs(df, x, "y"),
                  lambda x: R.dedup_times(df, x), lambda x: R.resample_nearest(df, x, step=1)):
        assert sorted(map(str, build(HOT).collect())) == sorted(map(str, build(fitted).collect()))


def test_fitting_without_long_recordings_keeps_them_whole(spark, skewed):
    fitted = fit_slices(skewed, HOT, max_rows=1_000_000)
    assert fitted.cuts == () and fitted.sliced(skewed).select("_slice").distinct().count() == 1


def test_results_do_not_depend_on_shuffle_partitions(spark, skewed):
    def results():
        return [
            sorted(map(tuple, O.number_rows(skewed.select("s", "i", "t"), HOT).collect())),
            sorted(map(tuple, R.block_mean(skewed, HOT, ["x"], 5, 2).withColumn("x", F.round("x", 9)).collect())),
            sorted(map(tuple, W.activity_runs(skewed, HOT, "y").collect())),
        ]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(results())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_rows_without_identity_are_reported(spark):
    from stridelake.operators.quality import validate_samples

    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (None, 3, 2), (2, None, 3), (3, 9, 4)], "s int, t bigint, i int")
    got = sorted(map(tuple, validate_samples(df, HOT).collect()), key=str)
    assert got == sorted([(None, "no_place", 1), (2, "no_place", 1), (3, "two_rows", 1), (3, "two_increasing_times", 1)], key=str)
    with pytest.raises(ValueError, match="violations"):
        validate_samples(df, HOT, strict=True)


def test_missing_columns_are_named_before_any_job(spark):
    with pytest.raises(ValueError, match="missing columns"):
        O.number_rows(spark.range(1), HOT)


def test_windows_of_another_shape_are_reported(spark):
    from stridelake.operators.quality import validate_windows

    df = spark.createDataFrame([(0, [[1.0, 2.0]] * 3), (1, [[1.0, 2.0]] * 2), (2, [[1.0], [1.0, 2.0], [1.0]])], "w int, data array<array<double>>")
    got = sorted(map(tuple, validate_windows(df, "w", 3, 2).collect()))
    assert got == [(1, "steps", 2), (2, "channels", 1), (2, "ragged", 2)]
    with pytest.raises(ValueError, match="has 6"):
        validate_windows(df, "w", 3, 9, dimension=6)
