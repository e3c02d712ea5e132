"""Toxicity by weak supervision.

Many voters look at a text: lexicon terms (words and word beginnings that labelled toxic texts use and others do not)
and patterns (shouting, runs of marks, masked words).  A generative label model takes the votes alone: every voter
fires with a probability that depends on the hidden class; expectation and maximisation estimate prior and accuracies,
and voters that fire together within a class share their weight.  The given label is one more voter, and may be wrong.  A linear classifier over all words and beginnings
then learns from the model's posterior labels, so it also knows terms that no voter holds.

Texts of any length are read whole; null and empty ones have no terms and get the score of the intercept.  Without a
labelled row of both classes, the score is the labelled rate (0 without labels).  A doc_id labelled several times
counts as toxic if one label says so; repeated rows score alike.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from stridelake.llm.samples import bounded, id_remainder
from stridelake.llm.store import kept_table

#: Labelled rows that train (about, at most).
TRAINING_ROWS = 12_000
#: A lexicon term needs this many toxic texts and this share of toxic ones among its texts, and a toxic text this many terms.
LEAST_TEXTS, LEAST_SHARE, COVER = 4, 0.8, 8
#: Numbers of lexicon terms that are features of their own, whatever the terms: what one language teaches, a rarer one uses.
LEVELS = (1, 2, 3, 4, 6)
#: Lengths of word beginnings that are terms, and positions of the classifier's features.
BEGINNINGS, FEATURES = (4, 5), 1 << 15
#: Partitions of the training rows, whose number is bounded: every step of the fit sends a vector of FEATURES numbers per partition.
TRAINING_PARTITIONS = 8
#: The voter that repeats the given label; it has an accuracy like any other.
LABEL = "label:given"
#: Pattern voters: names and Java patterns.
PATTERNS = {
    "pattern:marks": r"[!?]{3,}",
    "pattern:shouting": r"(?:\b\p{Lu}{3,}\b[^\p{L}]+){5}",
    "pattern:masked": r"\b\p{L}+[*@#$]{2,}\p{L}*\b",
    "pattern:address": r"(?i)\b(you|du|tu|usted|vous) (are|bist|es|êtes) (an?|ein|eine|un|una|une)\b",
}


class LabelModel(NamedTuple):
    """Voters with their chance to fire in each class, their weights, and the prior."""

    voters: list[str]
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        hit = np.log(self.toxic / self.clean) * self.weight
        miss = np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + fired @ hit + (1 - fired) @ miss, -30, 30)))


def terms(text: Column) -> Column:
    """Distinct words of two letters or more, and beginnings of longer words."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 2))
    begins = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in BEGINNINGS]
    return F.array_distinct(F.concat(words, *begins))


def _lexicon(labelled: DataFrame) -> list[str]:
    """Strong terms, the commonest first among the toxic texts that have fewer than ``COVER`` of those chosen before.

    So a term of a few texts is chosen where no common one covers them, whatever language holds most rows.  What is
    gathered here is the strong terms of the toxic training rows, whose number is bounded.
    """
    each = labelled.select("__toxic", F.explode("__terms").alias("term"))
    counted = each.groupBy("term").agg(F.sum("__toxic").alias("toxic"), F.count("*").alias("texts"))
    strong = counted.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * F.col("texts"))).select("term")
    toxic = labelled.where("__toxic = 1").select("__row", F.explode("__terms").alias("term"))
    holding = toxic.join(strong, "term").groupBy("term").agg(F.collect_list("__row").alias("rows")).orderBy("term").collect()
    return covering({r["term"]: r["rows"] for r in holding})


def covering(rows_of: dict[str, list[int]], cover: int = COVER) -> list[str]:
    """Terms in the order of how many rows they add to, until each row has ``cover`` of them or no term is left for it."""
    have: dict[int, int] = {}
    waiting = [(-len(rows), term) for term, rows in rows_of.items()]
    heapq.heapify(waiting)
    chosen = []
    while waiting:
        gain, term = heapq.heappop(waiting)
        now = -sum(have.get(r, 0) < cover for r in rows_of[term])
        if now == 0:
            continue
        if now > gain:  # it adds less than when it was put in; it may still be next
            heapq.heappush(waiting, (now, term))
            continue
        chosen.append(term)
        for r in rows_of[term]:
            have[r] = have.get(r, 0) + 1
    return chosen


def fit_label_model(voters: list[str], fired: np.ndarray, count: np.ndarray, anchor: int, rounds: int = 25) -> LabelModel:
    """Estimate the model from distinct vote rows and their counts; the voter at ``anchor`` (the given label) starts it off."""
    post = np.where(fired[:, anchor] > 0, 0.95, 0.05)
    weight, correlation = np.ones(len(voters)), np.eye(len(voters))
    model = None
    for _ in range(rounds):
        yes, no = count * post, count * (1 - post)
        p = (fired.T @ yes + 0.5) / (yes.sum() + 1)
        q = (fired.T @ no + 0.5) / (no.sum() + 1)
        # Correlation of voters within the classes, averaged over both.
        correlation = np.zeros((len(voters), len(voters)))
        for mass, rate in ((yes, p), (no, q)):
            centred = (fired - rate) * np.sqrt(mass)[:, None]
            deviation = np.sqrt(np.maximum(rate * (1 - rate) * mass.sum(), 1e-9))
            correlation += 0.5 * (centred.T @ centred) / np.outer(deviation, deviation)
        near = np.clip(correlation, 0, 1) * (1 - np.eye(len(voters)))
        near[near < 0.1] = 0
        near[anchor] = near[:, anchor] = 0  # voters agree with the label because both follow the class
        weight = 1 / (1 + near.sum(1))
        prior = float(np.clip(yes.sum() / count.sum(), 1e-3, 1 - 1e-3))
        model = LabelModel(voters, np.clip(p, 1e-4, 1 - 1e-4), np.clip(q, 1e-4, 1 - 1e-4), weight, correlation, prior)
        post = model.posterior(fired)
    return model


class Toxicity(NamedTuple):
    """A fitted scorer; ``model`` is None where only a constant could be learned."""

    model: object | None
    label_model: LabelModel | None
    constant: float
    lexicon: list[str] = []

    def scored(self, docs: DataFrame, column: str) -> DataFrame:
        """``docs`` with the score of ``text`` in ``column``; other columns stay."""
        if self.model is None:
            return docs.withColumn(column, F.lit(self.constant))
        own = terms(F.coalesce(F.col("text").cast("string"), F.lit("")))
        made = _features(docs.withColumn("__terms", _with_levels(own, self.lexicon)))
        # Only the feature column goes through the model, whose output columns have fixed names.
        probability = self.model.setFeaturesCol("__features").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__probability").transform(made)
        return probability.withColumn(column, vector_to_array("__probability")[1]).drop("__terms", "__features", "__probability")


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed a single time, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _with_levels(found: Column, lexicon: list[str]) -> Column:
    """A text's terms, and as terms the levels that its number of lexicon terms reaches."""
    known = F.array(*(F.lit(t) for t in lexicon)).cast("array<string>")

    def levels(n: Column) -> Column:
        return F.filter(F.array(*(F.when(n >= k, F.lit(f"lexicon:{k}")) for k in LEVELS)), lambda r: r.isNotNull())

    return _once(found, lambda t: F.concat(t, _once(F.size(F.array_intersect(t, known)), levels)))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__terms", outputCol="__features", numFeatures=FEATURES, binary=True).transform(df)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Toxicity:
    """Fit on ``doc_id, text`` and ``doc_id, toxic``; only ids with a crc32 remainder other than 0 by 5 are used."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = bounded(known.where(id_remainder(5) != 0), "doc_id", rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.select("doc_id", text.alias("text")).join(known, "doc_id")
    marks = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(name)) for name, p in PATTERNS.items())), lambda m: m.isNotNull())
    described = joined.select(F.monotonically_increasing_id().alias("__row"), "__toxic", terms(F.col("text")).alias("__terms"), marks.alias("__marks"))
    labelled = kept_table(described, "labelled")
    n, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("__toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return Toxicity(None, None, positive / n if n else 0.0)
    lexicon = _lexicon(labelled)
    voters = [LABEL, *lexicon, *PATTERNS]
    given = F.when(F.col("__toxic") == 1, F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))
    fired = F.array_sort(F.array_intersect(F.concat(given, "__terms", "__marks"), F.array(*(F.lit(v) for v in voters))))
    voted = labelled.withColumn("__fired", fired)
    # Distinct vote rows are fewer than the training rows.
    patterns = voted.groupBy("__fired").agg(F.count("*").alias("n")).collect()
    place = {v: i for i, v in enumerate(voters)}
    matrix = np.zeros((len(patterns), len(voters)))
    for i, row in enumerate(patterns):
        matrix[i, [place[v] for v in row["__fired"]]] = 1
    model = fit_label_model(voters, matrix, np.array([r["n"] for r in patterns], float), anchor=0)
    posterior = [(list(r["__fired"]), float(p)) for r, p in zip(patterns, model.posterior(matrix))]
    seen = voted.withColumn("__terms", _with_levels(F.col("__terms"), lexicon))
    soft = seen.join(docs.sparkSession.createDataFrame(posterior, "__fired array<string>, p double"), "__fired")
    # A soft label is two weighted rows; the rarer toxic side counts more, by the root of what would balance the classes.
    weight = float(np.sqrt((1 - model.prior) / model.prior))
    sides = soft.select("__terms", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (weight * F.col("p")).alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("s"))
    rows_ = _features(sides.select("__terms", "s.label", "s.w").where("w > 0.01")).select("__features", "label", "w").coalesce(TRAINING_PARTITIONS)
    fitted = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="w", regParam=0.00002, elasticNetParam=0.8, maxIter=80, standardization=False).fit(rows_)
    return Toxicity(fitted, model, positive / n, lexicon)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5)."""
    scored = fit_toxicity(docs, labels).scored(docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``limit`` or more; all columns stay."""
    return fit_toxicity(docs, labels).scored(docs, "__score").where(F.col("__score") < limit).select(*docs.columns)
