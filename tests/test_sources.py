from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.sources import samples as R
from stridelake.sources import windows as D
from stridelake.sources.catalog import catalog_entry, load_catalog
from stridelake.sources.folders import shared_folder, stored


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_phone_log_with_missing_activity(spark, tmp_path):
    path = put(
        tmp_path / "acc.csv",
        "Index,Arrival_Time,Creation_Time,x,y,z,User,Model,Device,gt\n"
        "0,1424696633908,1424696631913248572,-5.9,0.6,8.1,a,nexus4,nexus4_1,stand\n"
        "1,1424696633909,1424696631918283972,-5.8,0.7,8.2,a,nexus4,nexus4_1,\n",
    )
    rows = R.read_samples(spark, path, R.PHONE_SCHEMA, columns=["Creation_Time", "x", "gt"], drop_malformed=True).orderBy("Creation_Time").collect()
    assert [tuple(r) for r in rows] == [(1424696631913248572, -5.9, "stand"), (1424696631918283972, -5.8, None)]


def test_trial_files_with_keys_in_the_path(spark, tmp_path):
    put(tmp_path / "dws_1" / "sub_3.csv", ",x,y,z\n0,1.0,2.0,3.0\n1,4.0,5.0,6.0\n")
    put(tmp_path / "jog_9" / "sub_12.csv", ",x,y,z\n0,7.0,8.0,9.0\n")
    keys = {"activity": ("/([a-z]+)_[0-9]+/[^/]*$", "string"), "user": ("sub_([0-9]+)[.]csv", "int"), "shift": ("none_([0-9]+)", "int")}
    df = R.read_samples(spark, f"{tmp_path}/*/*.csv", "row int, x double, y double, z double", columns=["x", "z"], path_keys=keys, drop_malformed=True)
    assert sorted(map(tuple, df.collect())) == [(1.0, 3.0, "dws", 3, None), (4.0, 6.0, "dws", 3, None), (7.0, 9.0, "jog", 12, None)]


def test_space_separated_log_keeps_the_named_columns(spark, tmp_path):
    line = " ".join(str(float(i)) for i in range(23))
    path = put(tmp_path / "Motion.txt", f"{line}\n{line}\n")
    df = R.read_samples(spark, path, R.doubles(R.LONG_LOG_COLUMNS), sep=" ", header=False, columns=R.LONG_LOG_KEPT, drop_malformed=True)
    assert df.columns == R.LONG_LOG_KEPT and df.first().gra_z == 16.0 and df.count() == 2
    with pytest.raises(ValueError):
        R.read_samples(spark, path, R.doubles(["a"]), columns=["b"])


def test_second_header_line_is_left_out_or_kept_as_text(spark, tmp_path):
    path = put(tmp_path / "p.csv", "left,,right\nt,x,name\n1,2.5,walking\n2,oops,sitting\n")
    schema = "t int, x double, name string"
    assert [tuple(r) for r in R.read_samples(spark, path, schema, drop_malformed=True).collect()] == [(1, 2.5, "walking")]
    kept = R.read_samples(spark, path, schema, columns=["t", "x"])
    assert sorted((r.t or 0, r.x or 0, r[R.MALFORMED] or "") for r in kept.collect()) == [(0, 0, "t,x"), (1, 2.5, ""), (2, 0, "2,oops")]
    assert tuple(R.count_malformed(kept).first()) == (3, 2)
    # A bad value in a column that nobody asked for costs no row.
    assert R.read_samples(spark, path, schema, columns=["t"], drop_malformed=True).count() == 2


def test_label_segments(spark, tmp_path):
    path = put(tmp_path / "labels.txt", "1 1 5 250 1232\n1 1 7 1233 1392\n")
    df = R.read_labels(spark, path, "exp int, user int, activity int, start_idx bigint, end_idx bigint", ["activity", "end_idx"], drop_malformed=True)
    assert sorted(map(tuple, df.collect())) == [(5, 1232), (7, 1392)]


def test_semicolon_round_trip(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") / 4).alias("x"))
    R.write_samples_csv(df, f"{tmp_path}/out", sep=";")
    assert sorted(map(tuple, R.read_samples(spark, f"{tmp_path}/out", df.schema, sep=";", drop_malformed=True).collect())) == sorted(map(tuple, df.collect()))


def test_window_sets_are_pruned_by_version(spark, tmp_path):
    made = spark.range(4).select(F.col("id").alias("window_id"), F.expr("array(array(id + 0.5D))").alias("data"))
    D.write_windows(made, f"{tmp_path}/w", "walks", 20, 120, 120)
    D.write_windows(made.limit(1), f"{tmp_path}/w", "walks", 20, 120, 60)
    back = D.read_windows(spark, f"{tmp_path}/w", "walks", rate_hz=20, window=120, step=60)
    assert back.count() == 1 and back.schema["data"].dataType.simpleString() == "array<array<float>>"
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert all(f"({name}#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] for name in D.PARTITIONS)


def test_array_files_become_window_rows(spark, tmp_path):
    values = np.arange(2 * 3 * 8, dtype="float64").reshape(2, 3, 8)
    np.save(tmp_path / "data_a.npy", values)
    np.save(tmp_path / "data_b.npy", values[:1] + 100)
    rows = D.import_npy(spark, f"{tmp_path}/data_*.npy", 6, slice_rows=1).orderBy("file", "window_no").collect()
    assert [(r.file[-5], r.window_no) for r in rows] == [("a", 0), ("a", 1), ("b", 0)]
    np.testing.assert_array_equal(np.array(rows[1].data), values[1, :, :6])
    with pytest.raises(Exception, match="needs 9 channels"):
        D.import_npy(spark, f"{tmp_path}/data_*.npy", 9).collect()
    np.save(tmp_path / "flat.npy", values[0])
    with pytest.raises(Exception, match="expected rank 3"):
        D.import_npy(spark, f"{tmp_path}/flat.npy", 6).collect()


def test_label_files_of_both_ranks(spark, tmp_path):
    np.save(tmp_path / "l3.npy", np.array([[[1, 7], [2, 8]], [[3, 9], [3, 9]]], dtype="float64"))
    np.save(tmp_path / "l1.npy", np.array([4.0, 5.0]))
    assert [r.labels for r in D.import_label_npy(spark, f"{tmp_path}/l3.npy").collect()] == [[1, 7], [3, 9]]
    assert [r.labels for r in D.import_label_npy(spark, f"{tmp_path}/l1.npy").collect()] == [[4], [5]]


@pytest.fixture
def catalog(spark, tmp_path):
    entries = {
        "walks_20_120": {
            "sr": 20, "seq_len": 120, "dimension": 6, "size": 40, "activity_label_index": 1, "activity_label_size": 2,
            "activity_label": ["sit", "walk"], "user_label_index": 0, "user_label_size": 9,
        },
        "rides_50_300": {"sr": 50, "seq_len": 300, "dimension": 9, "size": 7, "activity_label_index": 0, "activity_label_size": 1, "activity_label": ["bike"]},
    }
    return load_catalog(spark, put(tmp_path / "catalog.json", json.dumps(entries, indent=2)))


def test_catalog_lookup_is_by_kind_name(catalog):
    entry = catalog_entry(catalog, "walks", "20_120")
    assert (entry.rate_hz, entry.window, entry.dimension, entry.size) == (20, 120, 6, 40)
    assert list(entry.kind("activity").names) == ["sit", "walk"] and entry.kind("user").names is None
    assert entry.kind("user").count == 9
    with pytest.raises(ValueError, match="no position label"):
        entry.kind("position")
    with pytest.raises(ValueError, match="no window set"):
        catalog_entry(catalog, "walks", "10_100")


class Session:
    """The parts of a session that the choice of a folder looks at."""

    def __init__(self, master, settings):
        self.sparkContext = self
        self.master = master
        self.conf = settings


def test_shared_folder_follows_the_setting(spark):
    assert shared_folder(Session("spark://host", {"spark.checkpoint.dir": "/shared/"}), "x").startswith("/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host", {}))
    assert stored(spark.range(3)).count() == 3


def made_windows(spark, values, label=1):
    return spark.createDataFrame([(i, [[float(v)]], label) for i, v in enumerate(values)], "window_id int, data array<array<double>>, label int")


def test_a_version_is_replaced_and_others_stay(spark, tmp_path):
    path = f"{tmp_path}/w"

    def read(**chosen):
        return sorted((r.dataset, r.step, r.data[0][0]) for r in D.read_windows(spark, path, **chosen).collect())

    D.write_windows(made_windows(spark, [1, 2]), path, "a", 20, 1, 1)
    D.write_windows(made_windows(spark, [3]), path, "a", 20, 1, 2)
    D.write_windows(made_windows(spark, [4]), path, "b", 20, 1, 1)
    D.write_windows(made_windows(spark, [1, 2]), path, "a", 20, 1, 1)  # a rerun doubles nothing
    assert read() == [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)]
    D.write_windows(made_windows(spark, [5]), path, "a", 20, 1, 1)
    D.write_windows(made_windows(spark, [6]), path, "a", 20, 1, 1, mode="append")
    assert read(dataset="a") == [("a", 1, 5.0), ("a", 1, 6.0), ("a", 2, 3.0)]
    # A write that fails before its manifest row is seen by no reader.
    (spark.createDataFrame([(9, [[9.0]], 1)], "window_id int, data array<array<float>>, label int").selectExpr("*", "'a' dataset", "20 rate_hz", "1 window", "1 step", "'lost' version")
     .write.mode("append").partitionBy(*D.PARTITIONS, "version").parquet(path))
    assert read(dataset="a", step=1) == [("a", 1, 5.0), ("a", 1, 6.0)]
    assert D.drop_old_versions(spark, path) == 2 and read(dataset="b") == [("b", 1, 4.0)] and len(read()) == 4
    plan = D.read_windows(spark, path, dataset="b")._jdf.queryExecution().executedPlan().toString()
    assert "version" in plan.split("PartitionFilters")[1][:300]
    with pytest.raises(ValueError, match="replace or append"):
        D.write_windows(made_windows(spark, [1]), path, "a", 20, 1, 1, mode="overwrite")


def test_a_summary_comes_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(i, [[1.0, 2.0]] * (i % 3), i * 37, None if i == 5 else -1 if i == 6 else 3) for i in range(1000)],
                               "window_id int, data array<array<double>>, user int, label int")
    found = D.write_windows(df, f"{tmp_path}/w", "a", 20, 2, 2, labels=["user", "label"])
    assert (found["n_windows"], found["n_steps"], found["n_channels"]) == (1000, 2, 2)
    assert found["user_ids"] == [i * 37 for i in range(1000) if i * 37 < 32768] and found["user_outside"] == 1000 - len(found["user_ids"])
    assert found["label_ids"] == [3] and found["label_outside"] == 1
    from stridelake.operators.quality import label_ids, summarize_windows

    ids = {(r.kind, r.id) for r in label_ids(df, ["user", "label"]).collect()}
    assert ids == {("user", i * 37) for i in range(1000)} | {("label", 3), ("label", -1)}
    row = summarize_windows(df, ["user", "label"]).first()
    assert (row.n_windows, row.user_count, row.label_count) == (1000, 1000, 2)
    empty = D.write_windows(df.limit(0), f"{tmp_path}/e", "a", 20, 2, 2, labels=["user"])
    assert empty["n_windows"] == 0 and empty["user_ids"] == []


def test_labels_of_all_steps_are_imported_and_merged(spark, tmp_path):
    from stridelake.operators.windows import merge_window_labels

    labels = np.array([[[1, 7], [1, 7], [1, 8]], [[0, 9], [2, 9], [2, 9]], [[0, 1], [0, 1], [0, 1]]])
    np.save(f"{tmp_path}/l3.npy", labels)
    np.save(f"{tmp_path}/l1.npy", np.array([4, 5]))
    steps = D.import_label_steps(spark, f"{tmp_path}/l3.npy", slice_rows=2)
    assert sorted((r.window_no, r.step, r.labels) for r in steps.collect()) == [(w, s, labels[w, s].tolist()) for w in range(3) for s in range(3)]
    assert sorted((r.window_no, r.step, r.labels) for r in D.import_label_steps(spark, f"{tmp_path}/l1.npy").collect()) == [(0, 0, [4]), (1, 0, [5])]
    kinds = steps.select("window_no", "step", F.col("labels")[0].alias("activity"))
    merged = {m: {r.window_no: r.activity for r in merge_window_labels(kinds, ["window_no"], "activity", m).collect()} for m in ("all", "any")}
    assert merged["all"] == {0: 1, 2: 0} and merged["any"] == {0: 1, 1: 2, 2: 0}
