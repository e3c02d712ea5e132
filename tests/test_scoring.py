"""Networks against scalar restatements; batches; model selection."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import nets
from stridelake.functions.batch import score
from stridelake.operators import scoring as M

STEPS, FEATURES, HIDDEN, HEADS = 5, 6, 8, 2


@pytest.fixture(scope="module")
def weights():
    made = nets.random_weights(1, FEATURES, HIDDEN, 12, STEPS, recurrent=(4, 3), classes=3, scale=0.5)
    rng = np.random.default_rng(9)
    return {k: (rng.normal(size=v.shape) * 0.3 + (".gain" in k)).astype("float64") for k, v in made.items()}


def dense(x, w, name):
    return [sum(w[f"{name}.w"][o][i] * x[i] for i in range(len(x))) + w[f"{name}.b"][o] for o in range(len(w[f"{name}.b"]))]


def norm(x, w, name):
    mean = sum(x) / len(x)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-12)
    return [(v - mean) / deviation * g + b for v, g, b in zip(x, w[f"{name}.gain"], w[f"{name}.bias"])]


def gelu(v):
    return v * 0.5 * (1 + math.erf(v / math.sqrt(2)))


def add(a, b):
    return [x + y for x, y in zip(a, b)]


def encode_by_hand(window, w, layers):
    h = [norm(add(norm(dense(x, w, "input"), w, "input_norm"), w["position"][t]), w, "input_norm") for t, x in enumerate(window)]
    size = HIDDEN // HEADS
    for _ in range(layers):
        q, k, v = ([dense(x, w, name) for x in h] for name in ("query", "key", "value"))
        mixed = []
        for t in range(len(h)):
            row = []
            for head in range(HEADS):
                part = slice(head * size, (head + 1) * size)
                logits = [sum(a * b for a, b in zip(q[t][part], k[u][part])) / math.sqrt(size) for u in range(len(h))]
                total = sum(math.exp(x) for x in logits)
                for c in range(size):
                    row.append(sum(math.exp(x) / total * v[u][part][c] for u, x in enumerate(logits)))
            mixed.append(row)
        h = [norm(add(x, dense(x, w, "mix")), w, "norm1") for x in mixed]
        h = [norm(add(x, dense([gelu(y) for y in dense(x, w, "wide")], w, "narrow")), w, "norm2") for x in h]
    return h


def sigmoid(v):
    return 1 / (1 + math.exp(-v))


def classify_by_hand(steps, w, layers):
    for layer in range(layers):
        size = w[f"rnn{layer}.state.w"].shape[1]
        h, out = [0.0] * size, []
        for x in steps:
            i, s = dense(x, w, f"rnn{layer}.input"), dense(h, w, f"rnn{layer}.state")
            new = []
            for c in range(size):
                r, z = sigmoid(i[c] + s[c]), sigmoid(i[size + c] + s[size + c])
                n = math.tanh(i[2 * size + c] + r * s[2 * size + c])
                new.append((1 - z) * n + z * h[c])
            h = new
            out.append(h)
        steps = out
    return dense(steps[-1], w, "out")


def test_networks_equal_their_scalar_restatement(weights):
    x = np.random.default_rng(4).normal(size=(2, STEPS, FEATURES))
    emb = nets.encode(x, weights, HEADS, layers=2)
    logits = nets.classify(emb, weights, layers=2)
    for b in range(2):
        by_hand = encode_by_hand(x[b].tolist(), weights, 2)
        np.testing.assert_allclose(emb[b], by_hand, atol=1e-5)
        np.testing.assert_allclose(logits[b], classify_by_hand(by_hand, weights, 2), atol=1e-5)


def test_erf():
    x = np.linspace(-4, 4, 201)
    np.testing.assert_allclose(nets.erf(x), [math.erf(v) for v in x], atol=2e-7)


@pytest.fixture(scope="module")
def window_set(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=(10, 6)).astype("float32").tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "window_id int, data array<array<float>>")


def bundle():
    return nets.random_weights(2, 6, 24, 48, 10, classes=4)


def test_results_do_not_depend_on_batches_or_partitions(window_set):
    def run(df, batch):
        return M.score_windows(df, bundle(), bundle(), batch=batch).orderBy("window_id").collect()

    a, b = run(window_set, 128), run(window_set.repartition(7), 9)
    np.testing.assert_allclose([r.scores for r in a], [r.scores for r in b], atol=1e-5)
    assert [r.predicted for r in a] == [int(np.argmax(r.scores)) for r in a]


def test_one_pass_equals_two(window_set):
    fused = M.score_windows(window_set, bundle(), bundle()).orderBy("window_id").collect()
    emb = M.embed_windows(window_set, bundle())
    assert len(emb.first().emb) == 10 and len(emb.first().emb[0]) == 24
    two = M.classify_windows(emb, bundle()).orderBy("window_id").collect()
    np.testing.assert_allclose([r.scores for r in fused], [r.scores for r in two], atol=1e-5)


def test_user_functions_of_both_ranks(window_set):
    flat = score(window_set, lambda x: x.sum(axis=(1, 2))[:, None], dtype="float64").collect()
    raw = {r.window_id: np.array(r.data).sum() for r in window_set.collect()}
    assert all(math.isclose(r.scores[0], raw[r.window_id], abs_tol=1e-4) for r in flat)
    deep = score(window_set, lambda x: x[:, ::2] * 2, out="half", rank=2).first()
    assert len(deep.half) == 5


def test_selection_prefers_the_first_of_equal_candidates(spark):
    rows = [(i, [float(i % 2), 1.0], i % 2, ["train", "vali", "test"][i % 3]) for i in range(60)]
    parts = spark.createDataFrame(rows, "window_id int, pooled array<double>, label int, split string")
    train = parts.filter("split = 'train'")
    models = [M.fit_classifier(train, reg=r) for r in (0.01, 0.02)]
    best, report = M.select_best(models, parts)
    assert best is models[0]
    assert {r.split: r.accuracy for r in report.collect()} == {"train": 1.0, "vali": 1.0, "test": 1.0}


def test_pca_equals_the_singular_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "window_id int, features array<double>")
    got = np.array([r.projected for r in M.pca_project(df, 2).orderBy("window_id").collect()])
    _, _, directions = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ directions[:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_pca_of_wide_windows_keeps_the_driver_small(spark, monkeypatch):
    """8,640 columns of which five directions matter: what is collected is columns x basis, and directions agree with numpy's."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 5)) @ np.diag([50, 30, 20, 10, 5]) @ rng.normal(size=(5, 8640)) + rng.normal(size=(120, 8640)) * 0.01 + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "window_id int, features array<double>").repartition(4)
    sizes = []
    sums = M._row_sums
    monkeypatch.setattr(M, "_row_sums", lambda *a: sizes.append((a[2], a[4])) or sums(*a))
    model = M.fit_pca(df, 3)
    assert set(sizes) == {(8640, 1), (8640, 11)}
    _, lengths, directions = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(model.variance, lengths[:3] ** 2 / len(x), rtol=1e-9)
    np.testing.assert_allclose(np.abs(model.directions.T @ directions[:3].T), np.eye(3), atol=1e-6)
    got = np.array([r.projected for r in M.project(df, model).orderBy("window_id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ directions[:3].T), rtol=1e-5, atol=1e-4)


def test_null_rows_have_no_projection(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 1.0])], "window_id int, features array<double>")
    rows = {r.window_id: r.projected for r in M.pca_project(df, 2).collect()}
    assert rows[1] is None and len(rows[0]) == len(rows[2]) == 2
    with pytest.raises(ValueError, match="no rows"):
        M.fit_pca(df.filter("window_id = 1"), 1)


def test_models_are_compared_in_one_pass(spark):
    """One scan in the plan for any number of candidates, and counts as from predictions one by one."""
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(3)), ["train", "vali", "test"][i % 3]) for i in range(200)]
    parts = spark.createDataFrame(rows, "window_id int, pooled array<double>, label int, split string")
    models = [M.LinearModel(rng.normal(size=(3, 3)), rng.normal(size=3)) for _ in range(4)]
    cells = M.confusion_of_models(models, parts, "pooled", "label")
    assert cells._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1
    want = {}
    for i, x, label, split in rows:
        for k, m in enumerate(models):
            cell = (k, split, label, int((m.coefficients @ x + m.intercepts).argmax()))
            want[cell] = want.get(cell, 0) + 1
    assert {tuple(r)[:4]: r.n_rows for r in cells.collect()} == want
    best, report = M.select_best(models, parts)
    accuracy = lambda k, part: sum(n for c, n in want.items() if c[0] == k and c[1] == part and c[2] == c[3]) / sum(n for c, n in want.items() if c[0] == k and c[1] == part)
    chosen = max(range(4), key=lambda k: (accuracy(k, "vali"), -k))
    assert best is models[chosen] and {r.split: round(r.accuracy, 9) for r in report.collect()} == {p: round(accuracy(chosen, p), 9) for p in ("train", "vali", "test")}
    with pytest.raises(ValueError, match="no candidate"):
        M.select_best([], parts)
