from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.functions import features as X
from stridelake.operators import columns as C
from stridelake.operators import metrics as E


def window_set(spark, arrays):
    return spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(arrays)], "window_id int, data array<array<double>>")


def arrays_of(df, column="data"):
    return [np.array(r[column], dtype=float) for r in df.orderBy("window_id").collect()]


@pytest.fixture(scope="module")
def nine_channels():
    rng = np.random.default_rng(1)
    made = rng.normal(size=(3, 12, 9)) * 5
    made[0, 0, 6:9] = 0  # a silent magnetometer
    return made


@pytest.mark.parametrize("channels,acc,mag", [(5, True, True), (6, True, True), (9, True, True), (9, False, True), (9, True, False)])
def test_normalize(spark, nine_channels, channels, acc, mag):
    got = arrays_of(X.normalize(window_set(spark, nine_channels), channels, acc, mag, gamma=0.5))
    for x, y in zip(nine_channels, got):
        want = x[:, :channels].copy()
        if channels >= 6 and acc:
            want[:, :3] /= 9.8
        if channels == 9 and mag:
            want[:, 6:] = 0.5 * x[:, 6:] / (np.sqrt((x[:, 6:] ** 2).sum(axis=1)) + 1e-5)[:, None]
        np.testing.assert_allclose(y, want, atol=1e-12)


@pytest.mark.parametrize("steps,ratio", [(120, 0.15), (20, 0.15), (2, 0.15), (10, 0.9)])
def test_span_masks_have_the_asked_count_and_leave_the_last_step(spark, steps, ratio):
    ids = spark.range(200).withColumnRenamed("id", "window_id")
    rows = X.span_mask(ids, "window_id", steps, ratio, seed=3).collect()
    for r in rows:
        assert len(set(r.pos)) == len(r.pos) == max(1, round(steps * ratio))
        assert r.pos == sorted(r.pos) and 0 <= r.pos[0] and r.pos[-1] < steps - 1
    if steps == 120:
        runs = sum(sum(b - a > 1 for a, b in zip(r.pos, r.pos[1:])) + 1 for r in rows) / len(rows)
        assert 3 < runs < 12  # spans, not single steps
        starts = {p for r in rows for p in r.pos}
        assert len(starts) > 110


def test_span_masks_do_not_depend_on_partitions_but_on_seed_and_epoch(spark):
    def draw(parts, **kw):
        ids = spark.range(0, 60, 1, parts).withColumnRenamed("id", "window_id")
        return [r.pos for r in X.span_mask(ids, "window_id", 120, **kw).orderBy("window_id").collect()]

    assert draw(1, seed=1) == draw(16, seed=1)
    assert draw(1, seed=1) != draw(1, seed=2) and draw(1, seed=1) != draw(1, seed=1, epoch=1)


def test_masks_that_cannot_be_drawn_are_refused(spark):
    ids = spark.range(1).withColumnRenamed("id", "window_id")
    for steps, ratio in ((1, 0.15), (10, 1.0)):
        with pytest.raises(ValueError):
            X.span_mask(ids, "window_id", steps, ratio)


def test_apply_mask_shares(spark):
    windows = spark.range(4000).select(
        F.col("id").alias("window_id"), F.expr("array(array(5D, 5D), array(6D, 6D))").alias("data"), F.expr("array(1)").alias("pos")
    )
    out = X.apply_mask(windows, "window_id", mask_prob=0.8, replace_prob=0.5, seed=4).select("masked").collect()
    assert all(r.masked[0] == [5.0, 5.0] for r in out)
    zero = sum(r.masked[1] == [0.0, 0.0] for r in out) / len(out)
    same = sum(r.masked[1] == [6.0, 6.0] for r in out) / len(out)
    assert abs(zero - 0.8) < 0.03 and abs(same - 0.1) < 0.03
    noise = [v for r in out for v in r.masked[1] if r.masked[1] not in ([0.0, 0.0], [6.0, 6.0])]
    assert all(0 <= v < 1 for v in noise) and abs(np.mean(noise) - 0.5) < 0.05


@pytest.mark.parametrize("steps", [4, 10, 15])
def test_spectrum_equals_the_library_transform(spark, steps):
    rng = np.random.default_rng(steps)
    made = rng.normal(size=(20, steps, 3))
    for x, y in zip(made, arrays_of(X.spectrum(window_set(spark, made)), "spectrum")):
        want = np.fft.fft(x, n=10, axis=0)
        np.testing.assert_allclose(y[:10], np.abs(want), atol=1e-9)
        np.testing.assert_allclose(y[10:], np.where(np.isin(np.arange(10), [0, 5])[:, None], np.angle(want.real + 0j), np.angle(want)), atol=1e-9)


def test_profile_uses_the_population_deviation(spark):
    row = X.profile(window_set(spark, np.arange(12.0).reshape(2, 3, 2))).first()
    assert (row.n_windows, row.n_steps, row.n_channels, row.n_values) == (2, 3, 2, 12)
    assert math.isclose(row.std_value, np.arange(12.0).std())


def test_truncation_and_presets(spark):
    df = window_set(spark, np.arange(12.0).reshape(2, 2, 3))
    assert arrays_of(C.truncate_channels(df, 2))[1].tolist() == [[6.0, 7.0], [9.0, 10.0]]
    with pytest.raises(Exception, match="needs 4 channels"):
        C.truncate_channels(df, 4).collect()
    assert C.preset_channels("right")[3] == "right_gyro_x"
    assert C.default_channels(9)[-1] == "mag_z" and C.default_channels(4) == ["feature_0", "feature_1", "feature_2", "feature_3"]
    for bad in (("left", 9), ("top", 6)):
        with pytest.raises(ValueError):
            C.preset_channels(*bad)
    with pytest.raises(ValueError, match="missing"):
        C.select_channels(df, ["x"])
    with pytest.raises(ValueError, match="expected 2"):
        C.select_channels(df, ["data"], expected=2)


def test_position_groups_follow_the_side_by_side_layout():
    columns = [f"k{i}" for i in range(71)]
    groups = C.position_groups(columns, 5)
    assert groups[0] == ["k1", "k2", "k3", "k7", "k8", "k9", "k10", "k11", "k12"]
    assert groups[4][0] == "k57" and groups[4][-1] == "k68"


def decisions(spark, pairs):
    return spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(pairs)], "window_id int, label int, predicted int")


def test_macro_f1_with_classes_on_one_side_only(spark):
    # class 2 is never predicted, class 3 never true
    df = decisions(spark, [(0, 0), (0, 0), (1, 0), (1, 1), (2, 3)])
    assert math.isclose(E.macro_f1(df).first().macro_f1, (0.8 + 2 / 3 + 0 + 0) / 4)
    both = E.accuracy_and_f1(df).first()
    assert math.isclose(both.accuracy, 0.6) and math.isclose(both.macro_f1, (0.8 + 2 / 3) / 4)
    dense = {(r.actual, r.predicted): r.n_rows for r in E.confusion_dense(E.confusion(df)).collect()}
    assert len(dense) == 16 and dense[2, 3] == 1 and dense[3, 3] == 0 and sum(dense.values()) == 5
    share = {(r.actual, r.predicted): r.share for r in E.confusion_normalized(E.confusion_dense(E.confusion(df))).collect()}
    assert share[0, 0] == 1.0 and share[3, 0] == 0.0 and share[1, 0] == 0.5


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.5, 0.7, 0.7],), ([1.0, 1.0, 0.0],)], "scores array<double>")
    assert [r.predicted for r in E.decide(df).collect()] == [1, 0]


def test_multitask_outcomes(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.5, 0.9]), (2, [0.0, 0.6])], "label int, scores array<double>")
    got = sorted(map(tuple, E.multitask_outcomes(df, 2, 0.5).collect()))
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize("ranges", [None, 1, 37])
def test_auc_with_ties_equals_the_pair_count(spark, ranges):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 8
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert math.isclose(E.roc_auc(df, ranges=ranges).first().auc, ((diff > 0) + 0.5 * (diff == 0)).mean())
    curve = E.roc_curve(df, ranges=ranges).orderBy(F.desc("threshold")).collect()
    for r in curve:
        assert math.isclose(r.tpr, (s[y == 1] >= r.threshold).mean()) and math.isclose(r.fpr, (s[y == 0] >= r.threshold).mean())


def test_auc_of_one_class_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert E.roc_auc(df).first().auc is None


def test_accuracy_is_skipped_when_sizes_differ(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1)], "id int, label int")
    predictions = spark.createDataFrame([(0, 1), (1, 0)], "id int, predicted int")
    assert E.accuracy_if_aligned(labels, predictions, "id").first().accuracy == 0.5
    assert E.accuracy_if_aligned(labels, predictions.limit(1), "id").first().accuracy is None


def test_auc_of_nothing_is_undefined(spark):
    assert E.roc_auc(spark.createDataFrame([], "label int, score double")).first().auc is None


def windows_of(spark, *data):
    return spark.createDataFrame(list(enumerate(data)), "window_id long, data array<array<double>>")


def test_score_refuses_ragged_and_null_windows(spark):
    from stridelake.functions.batch import score

    two, four = [[1.0], [2.0]], [[3.0]] * 4
    for bad in ((two, four), (two, None), (two, [[1.0], [2.0, 3.0]]), (two, [[1.0], None]), (two, [[1.0], [None]])):
        with pytest.raises(Exception, match="differ in shape|is null"):
            score(windows_of(spark, *bad).coalesce(1), lambda x: x.mean(axis=1), dtype="float64").collect()
    assert [r.scores for r in score(windows_of(spark, two, two), lambda x: x.mean(axis=1), dtype="float64").collect()] == [[1.5], [1.5]]


def test_narrow_steps_are_refused(spark):
    df = windows_of(spark, [[1.0, 2.0, 3.0]])
    for channels in (5, 6, 9):
        with pytest.raises(Exception):
            X.normalize(df, channels).collect()
    assert X.normalize(df, 2).first().data == [[1.0, 2.0]]


def test_empty_windows_count_in_profile_and_summary(spark):
    from stridelake.operators import quality as Q

    df = windows_of(spark, [[1.0, 3.0]], [], None)
    row = X.profile(df).first()
    assert (row.n_windows, row.n_values, row.mean_value, row.n_steps) == (3, 2, 2.0, 1)
    summary = Q.summarize_windows(df).first()
    assert (summary.n_windows, summary.n_steps, summary.n_channels) == (3, 1, 2)


def test_missing_predictions_are_misses_and_no_class(spark):
    from stridelake.operators import metrics as E

    df = spark.createDataFrame([(0, 0), (0, None), (1, 1), (1, 0)], "label int, predicted int")
    row = E.accuracy(df).first()
    assert (row.accuracy, row.n_rows) == (0.5, 4)
    scores = {r["class"]: (r.tp, r.fp, r.fn) for r in E.class_scores(E.confusion(df)).collect()}
    assert scores == {0: (1, 1, 1), 1: (1, 0, 1)}
    assert E.accuracy_and_f1(df).first().accuracy == 0.5


def test_dense_confusion_checks_its_classes(spark, monkeypatch):
    from stridelake.operators import metrics as E

    cells = E.confusion(spark.createDataFrame([(0, 1), (2, 2)], "label int, predicted int"))
    assert E.confusion_dense(cells).count() == 9
    monkeypatch.setattr(E, "MAX_GRID_CLASSES", 2)
    with pytest.raises(Exception, match="more than 2 classes"):
        E.confusion_dense(cells).collect()


def test_scores_without_a_place_are_left_out_of_the_curve(spark):
    from stridelake.operators import metrics as E

    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (float("nan"), 1), (None, 0), (0.5, None)], "score double, label int")
    assert E.roc_auc(df).first().auc == 1.0 and E.roc_curve(df).count() == 2


def test_null_labels_agree_with_nothing(spark):
    from stridelake.operators import windows as W

    long = spark.createDataFrame([(0, 0, 3), (0, 1, None), (1, 0, 3), (1, 1, 3), (2, 0, None), (2, 1, None)], "w int, step int, y int")
    assert [tuple(r) for r in W.merge_window_labels(long, ["w"], "y").collect()] == [(1, 3)]
    flagged = {r.w: r.ok for r in W.merge_window_labels(long, ["w"], "y", flag="ok").collect()}
    assert flagged == {0: False, 1: True, 2: False}
    rows = spark.createDataFrame([("a", i, i * 10, y) for i, y in enumerate([2, None, 2, 2])], "s string, i int, t long, y int")
    found = W.contiguous_windows(rows, Stream(("s",), "t", ("i",), 1000), 2, 2, 100, "y").collect()
    assert [(r.window_no, r.y) for r in found] in ([], [(1, 1)])
