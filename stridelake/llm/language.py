"""Language of texts by hierarchical discrimination.

A linear support vector machine per family says which family a text belongs to; within it, one machine per pair of
languages votes.  Features are hashed byte trigrams of the whole text (capital ASCII letters lowered), scaled to length 1.

Null texts, and those without a letter, are ``und`` with score 0.  Texts of fewer than three bytes have no trigram and
get what the intercepts say.  Without a learned language, every text is ``und``.  A language outside the family table
is a family of its own.  Rows without a language do not train; rows without an id count as one more id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame

from stridelake.llm import words as W
from stridelake.llm.samples import id_remainder, stratified
from stridelake.llm.store import kept_table

#: Families of language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
}
#: Rows that train (about, at most, unless languages are many), rows that a language may always have, and positions of trigrams.
TRAINING_ROWS, LANGUAGE_ROWS, FEATURES = 3000, 100, 2048
_PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of scaled trigram counts, some hundred texts at a time."""
    data, offsets = W.text_bytes(column)
    lower = W.lower_table()
    for a, b in W.pieces(offsets):
        for i in range(a, b, 500):
            j = min(i + 500, b)
            raw = lower[data[offsets[i] : offsets[j]]].astype(np.uint32)
            row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
            gram = ((raw[:-2] * 65_599 + raw[1:-1]) * 65_599 + raw[2:]) * np.uint32(2_654_435_761) if len(raw) > 2 else np.zeros(0, np.uint32)
            place = (gram >> np.uint32(16)) % FEATURES
            inside = row[:-2] == row[2:] if len(raw) > 2 else np.zeros(0, bool)
            counts = np.bincount(row[: len(place)][inside] * FEATURES + place[inside], minlength=(j - i) * FEATURES).reshape(j - i, FEATURES).astype(float)
            yield counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)


class Machine(NamedTuple):
    """Says ``first`` for a positive margin, else ``second``."""

    first: str
    second: str
    weights: np.ndarray
    intercept: float


class LanguageModel(NamedTuple):
    families: list[str]
    by_family: list[Machine]
    pairs: dict[str, list[Machine]]
    members: dict[str, list[str]]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of feature rows."""
        chosen, certainty = self._vote(x, self.families, self.by_family)
        out = [("und", 0.0)] * len(x)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                within, sure = self._vote(x[rows], self.members[name], self.pairs[name])
                for r, w, s in zip(rows, within, sure):
                    out[r] = (self.members[name][w], float(certainty[r] * s))
        return out

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
        votes, belief = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        for m in machines:
            p = 1 / (1 + np.exp(-2 * np.clip(x @ m.weights + m.intercept, -15, 15)))
            i, j = names.index(m.first), names.index(m.second)
            votes[:, i] += p > 0.5
            votes[:, j] += p <= 0.5
            belief[:, i] = np.minimum(belief[:, i], p)
            belief[:, j] = np.minimum(belief[:, j], 1 - p)
        best = np.argmax(votes + belief / 2, axis=1)  # belief decides ties
        return best, belief[np.arange(len(x)), best]


def _machine(rows: DataFrame, first: str, second: str, is_first: Column) -> Machine:
    model = LinearSVC(featuresCol="x", labelCol="y", regParam=0.0005, maxIter=25).fit(rows.select("x", F.when(is_first, 1.0).otherwise(0.0).alias("y")))
    return Machine(first, second, model.coefficients.toArray(), float(model.intercept))


def fit_languages(docs: DataFrame, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Fit on ``text`` and ``lang`` of rows whose id has a crc32 remainder other than 1 by 3.

    Every language of these rows is learned.  About ``rows`` of them train: each language has all its rows or an equal
    number picked by hash, ``LANGUAGE_ROWS`` at least.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & (id_remainder(3) != 1))

    def numbers(batches):
        for batch in batches:
            found = list(features(batch.column("text")))
            values = np.concatenate(found).astype(np.float32) if found else np.zeros((0, FEATURES), np.float32)
            arrays = pa.ListArray.from_arrays(np.arange(0, values.size + 1, FEATURES, dtype=np.int32), values.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), arrays], names=["lang", "x"])

    chosen = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs, sample = stratified(chosen, "lang", rows, LANGUAGE_ROWS)
    sample = kept_table(sample.select("lang", "text").mapInArrow(numbers, "lang string, x array<float>"), "trigrams")
    train = sample.select("lang", array_to_vector(F.col("x")).alias("x"))
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    by_family = [_machine(train.where(F.col("lang").isin(members[a] + members[b])), a, b, F.col("lang").isin(members[a])) for a, b in combinations(families, 2)]
    pairs = {
        name: [_machine(train.where(F.col("lang").isin(a, b)), a, b, F.col("lang") == a) for a, b in combinations(codes, 2)] for name, codes in members.items()
    }
    return LanguageModel(families, by_family, pairs, members)


def with_language(docs: DataFrame, model: LanguageModel, column: str) -> DataFrame:
    """``docs`` with a struct ``column`` of lang and score; other columns stay."""
    if not model.families:
        return docs.withColumn(column, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))

    @F.arrow_udf(_PREDICTED)  # the model, a few vectors of FEATURES numbers, travels with the function
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            made = [p for x in features(texts) for p in model.predict(x)]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in made], pa.string()), pa.array([p[1] for p in made], pa.float64())], names=["lang", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(column, predict(F.col("text").cast("string"))).withColumn(
        column, F.when(lettered, F.col(column)).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))))


def languages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    found = with_language(docs.select("doc_id", "text"), fit_languages(docs), "__found")
    return found.select("doc_id", (id_remainder(3) == 1).alias("held_out"), F.col("__found")["lang"].alias("lang_pred"), F.col("__found")["score"].alias("score"))
