"""Batch scoring of windows, and supervised models on pooled embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions import nets
from stridelake.functions.batch import score
from stridelake.functions.features import mean_pool, normalize
from stridelake.operators.metrics import argmax, class_scores
from stridelake.sources.folders import Stored

# Weights go to every executor; a larger model belongs in a file that the function loads.
MAX_WEIGHT_BYTES = 1 << 30


def _shared(df: DataFrame, weights: Mapping[str, np.ndarray]):
    """Weights of a given model once per executor, a few hundred kilobytes for the bundled nets."""
    size = sum(w.nbytes for w in weights.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weights of {size} bytes are too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(dict(weights))


def embed_windows(
    df: DataFrame, weights: Mapping[str, np.ndarray], channels: int = 6, heads: int = 4, layers: int = 4,
    batch: int = 128,
) -> DataFrame:
    """Normalise and encode windows: ``emb`` holds one vector per step."""
    shared = _shared(df, weights)
    return score(
        normalize(df, channels), lambda x: nets.encode(x, shared.value, heads, layers), out="emb", rank=2, batch=batch
    )


def classify_windows(df: DataFrame, weights: Mapping[str, np.ndarray], data: str = "emb", batch: int = 128) -> DataFrame:
    """Class scores and decision for embedded windows."""
    shared = _shared(df, weights)
    scored = score(df, lambda x: nets.classify(x, shared.value), data=data, batch=batch)
    return scored.withColumn("predicted", argmax("scores"))


def score_windows(
    df: DataFrame, encoder: Mapping[str, np.ndarray], classifier: Mapping[str, np.ndarray], channels: int = 6,
    heads: int = 4, layers: int = 4, batch: int = 128,
) -> DataFrame:
    """Raw windows to decisions in one pass; embeddings never leave the task."""
    first, second = _shared(df, encoder), _shared(df, classifier)
    scored = score(
        normalize(df, channels),
        lambda x: nets.classify(nets.encode(x, first.value, heads, layers), second.value),
        batch=batch,
    )
    return scored.withColumn("predicted", argmax("scores"))


def with_predictions(model: Model, df: DataFrame, vector: str) -> DataFrame:
    """``scores`` and ``predicted`` of a fitted classifier for an array column."""
    scored = model.transform(df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumns(
        {"scores": vector_to_array("probability"), "predicted": F.col("prediction").cast("int")}
    ).drop("_features", "rawPrediction", "probability", "prediction")


def fit_classifier(
    train: DataFrame, vector: str = "pooled", label: str = "label", reg: float = 0.0, iterations: int = 50
) -> Model:
    """A softmax classifier on an array column, fitted by Spark over the partitions."""
    features = train.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("_features"), F.col(label).cast("double").alias(label)
    )
    return LogisticRegression(
        featuresCol="_features", labelCol=label, regParam=reg, maxIter=iterations, family="multinomial"
    ).fit(features)


class LinearModel(NamedTuple):
    """Scores ``coefficients @ x + intercepts``, a row per class."""

    coefficients: np.ndarray
    intercepts: np.ndarray

    @classmethod
    def of(cls, model) -> LinearModel:
        if isinstance(model, cls):
            return model
        return cls(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def features_pooled(windows: DataFrame, width: int) -> DataFrame:
    return mean_pool(windows, width).drop("data")


def confusion_of_models(models: Sequence[LinearModel], parts: DataFrame, vector: str, label: str, split: str = "split") -> DataFrame:
    """``model, split, actual, predicted, n_rows`` of all models in one pass.

    The coefficients of all are stacked, so a batch is one product; what leaves a task is its counts.
    """
    weights = np.concatenate([m.coefficients for m in models])
    offsets = np.concatenate([m.intercepts for m in models])
    edges = np.cumsum([0] + [len(m.intercepts) for m in models]).tolist()

    def count(batches):
        cells: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            splits, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors = np.array(batch.column(2).to_pylist(), dtype="float64").reshape(batch.num_rows, -1)
            scores = vectors @ weights.T + offsets
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                for cell in zip(repeat(k), splits, labels, scores[:, a:b].argmax(axis=1).tolist()):
                    cells[cell] = cells.get(cell, 0) + 1
        columns = list(zip(*[(*cell, n) for cell, n in cells.items()])) or [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["model", "split", "actual", "predicted", "n_rows"])

    rows = parts.select(F.col(split).cast("string").alias("split"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    counted = rows.mapInArrow(count, "model int, split string, actual bigint, predicted bigint, n_rows bigint")
    return counted.groupBy("model", "split", "actual", "predicted").agg(F.sum("n_rows").alias("n_rows"))


def select_best(candidates: Iterable, parts: DataFrame, vector: str = "pooled", label: str = "label") -> tuple:
    """The candidate with the highest validation accuracy, the first of equals, and its report.

    Candidates are linear models: fitted by :func:`fit_classifier`, or :class:`LinearModel`.  ``parts`` carries ``split``
    and is read once for all of them; the report has accuracy and macro F1 per part and comes from their counts.
    """
    models = list(candidates)
    if not models:
        raise ValueError("no candidate, or no validation rows")
    cells = Stored(confusion_of_models([LinearModel.of(m) for m in models], parts, vector, label), "confusion").df
    scores = class_scores(cells, ["model", "split"]).groupBy("model", "split").agg(
        (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    first = scores.filter("split = 'vali'").orderBy(F.desc("accuracy"), "model").first()  # one number per model
    if first is None:
        raise ValueError("no candidate, or no validation rows")
    return models[first["model"]], scores.filter(F.col("model") == first["model"]).drop("model")


class Pca(NamedTuple):
    """Main directions (columns, by falling variance) of rows about their mean."""

    mean: np.ndarray
    directions: np.ndarray
    variance: np.ndarray


def _row_sums(df: DataFrame, vector: str, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``of(rows)``, a matrix of ``width`` x ``size`` for a batch of rows, summed in tasks and then in Spark row by row."""
    names = [f"c{j}" for j in range(size)]

    def add(batches):
        total = np.zeros((width, size))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(start, 1024)
                total += of(np.asarray(part.flatten()).reshape(len(part), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(size)]], names=["i", *names])

    schema = "i int, " + ", ".join(f"{c} double" for c in names)
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInArrow(add, schema)
    found = np.zeros((width, size))
    for r in rows.groupBy("i").agg(*[F.sum(c) for c in names]).collect():
        found[r[0]] = r[1:]
    return found


def fit_pca(df: DataFrame, dimensions: int, vector: str = "features", extra: int = 8, passes: int = 6, seed: int = 0) -> Pca:
    """The ``dimensions`` main directions, by a randomised range finder.

    A random basis of ``dimensions + extra`` directions is multiplied by the rows and back, ``C'(C V)``, and made
    orthonormal again, ``passes`` times; the directions are those of the rows within that basis.  A pass sums matrices of
    width x basis, so neither a task nor the driver holds one of width x width.  With as many directions as columns the
    basis is all of the space and one pass is exact.  Rows are of one width and without null entries; null rows are left out.
    """
    first = df.select(F.size(vector).alias("width")).filter("width > 0").first()
    if first is None:
        raise ValueError("no rows to take directions from")
    width = first[0]
    n = df.filter(F.col(vector).isNotNull()).count()
    mean = _row_sums(df, vector, width, lambda x: x.sum(axis=0)[:, None], 1)[:, 0] / n
    size = min(width, dimensions + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(passes if size < width else 1):
        held = basis
        image = _row_sums(df, vector, width, lambda x: (x - mean).T @ ((x - mean) @ held), size)
        basis = np.linalg.qr(image)[0] if size < width else basis
    if size < width:
        held = basis
        image = _row_sums(df, vector, width, lambda x: (x - mean).T @ ((x - mean) @ held), size)
    inner = basis.T @ image
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dimensions]
    directions = basis @ turns[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Pca(mean, directions * signs, np.maximum(values[order], 0) / n)


def project(df: DataFrame, model: Pca, vector: str = "features", out: str = "projected") -> DataFrame:
    """Rows about the mean in the model's directions; a null row stays null."""
    names = [c for c in df.columns if c != out]
    width = len(model.mean)
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def turn(batches):
        for batch in batches:
            values = batch.column("_vector")
            rows = np.asarray(values.drop_null().flatten()).reshape(-1, width)
            turned = iter(((rows - model.mean) @ model.directions).tolist())
            found = [next(turned) if known else None for known in values.is_valid().to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.list_(pa.float64()))], names=[*names, out])

    return df.select(*names, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(turn, schema)


def pca_project(df: DataFrame, dimensions: int, vector: str = "features", out: str = "projected") -> DataFrame:
    """Centre flattened windows and project them on the main directions (signs are fixed by the largest entry)."""
    return project(df, fit_pca(df, dimensions, vector), vector, out)
