"""Evaluation of predictions.  Every metric starts from counts, so rows shuffle as partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.ranges import sums_by_ranges

# Classes of a dense confusion grid, whose cells are their square.
MAX_GRID_CLASSES = 2000


def argmax(scores: str | Column) -> Column:
    """Place of the largest score, the first of equals."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def decide(df: DataFrame, scores: str = "scores", out: str = "predicted") -> DataFrame:
    """Argmax of ``scores``; choose another head of a model by its column."""
    return df.withColumn(out, argmax(scores))


def _match(label: str | Column, predicted: str | Column) -> Column:
    """1 for equal values; a null on either side is a miss."""
    label, predicted = (F.col(c) if isinstance(c, str) else c for c in (label, predicted))
    return F.coalesce(label == predicted, F.lit(False)).cast("double")


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of rows whose prediction is the label; a missing prediction is a miss."""
    return df.agg(
        F.avg(_match(label, predicted)).alias("accuracy"), F.count(F.lit(1)).alias("n_rows")
    )


def accuracy_if_aligned(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Accuracy over ``key``; null with a notice when the two sides differ in size."""
    sizes = labels.agg(F.count(F.lit(1)).alias("n_labels")).withColumn(
        "n_predictions", predictions.agg(F.count(F.lit(1))).scalar()
    )
    matches = labels.join(predictions, key).agg(F.avg(_match("label", "predicted"))).scalar()
    same = F.col("n_labels") == F.col("n_predictions")
    return sizes.withColumns(
        {
            "accuracy": F.when(same, matches),
            "notice": F.when(~same, F.lit("skipped: labels and predictions differ in number")),
        }
    )


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Counts of the cells that occur: ``by, actual, predicted, n_rows``."""
    return df.groupBy(*by, F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def confusion_dense(cells: DataFrame) -> DataFrame:
    """All cells over the classes seen on either side, empty ones with 0.

    The grid is the square of the classes, so more than ``MAX_GRID_CLASSES`` of them
    end the query; :func:`confusion` and :func:`class_scores` take any number.
    """
    sides = cells.select("actual").union(cells.select("predicted")).where("actual is not null").distinct()
    bounded = sides.withColumn("_n", sides.agg(F.count("*")).scalar()).withColumn(
        "_class", F.when(F.col("_n") <= MAX_GRID_CLASSES, F.col("actual")).otherwise(
            F.raise_error(F.lit(f"more than {MAX_GRID_CLASSES} classes; use the sparse counts")).cast(sides.schema["actual"].dataType)))
    classes = F.collect_set("_class")
    seen = bounded.agg(classes.alias("_classes")).filter("size(_classes) > 0")
    grid = seen.select(F.explode("_classes").alias("actual"), "_classes").select(
        "actual", F.explode("_classes").alias("predicted")
    )
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows")
    )


def confusion_normalized(dense: DataFrame) -> DataFrame:
    """Share of each predicted class in the rows of an actual class, 0 where it has none."""
    rows = F.sum("n_rows").over(Window.partitionBy("actual"))  # one row per class pair
    return dense.select(
        "actual", "predicted", F.when(rows > 0, F.col("n_rows") / rows).otherwise(F.lit(0.0)).alias("share")
    )


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives, false negatives and F1 per class seen on either side.

    A null is no class: a row without prediction is a false negative of its label,
    one without label a false positive of its prediction.
    """
    hit = F.coalesce(F.col("actual") == F.col("predicted"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    n = F.col("n_rows")

    def part(cls: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    as_actual = part("actual", F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n))
    as_predicted = part("predicted", zero, F.when(hit, zero).otherwise(n), zero)
    sums = cells.select(*by, F.explode(F.array(as_actual, as_predicted)).alias("_p")).where("_p.class is not null").groupBy(*by, "_p.class").agg(
        *[F.sum(f"_p.{c}").alias(c) for c in ("tp", "fp", "fn")]
    )
    double_tp = F.col("tp") * 2
    whole = double_tp + F.col("fp") + F.col("fn")
    return sums.withColumn("f1", F.when(whole > 0, double_tp / whole).otherwise(F.lit(0.0)))


def macro_f1(df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Plain mean of the classes' F1."""
    return class_scores(confusion(df, label, predicted, by), by).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes")
    )


def accuracy_and_f1(df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Both headline numbers from one confusion table; every row of it is read twice only as counts."""
    scores = class_scores(confusion(df, label, predicted, by), by)
    return scores.groupBy(*by).agg(
        (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def multitask_outcomes(
    df: DataFrame, tasks: int, threshold: float = 0.5, label: str = "label", scores: str = "scores"
) -> DataFrame:
    """Label 0 is a negative of every task, label k a positive of task k - 1."""
    task = F.when(F.col(label) == 0, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.col(label) - 1))
    return df.select(label, scores, F.explode(task).alias("_task")).select(
        (F.col(label) > 0).cast("int").alias("label"),
        (F.get(F.col(scores), F.col("_task")) > threshold).cast("int").alias("predicted"),
    )


def multitask_metrics(
    df: DataFrame, tasks: int, threshold: float = 0.5, label: str = "label", scores: str = "scores"
) -> DataFrame:
    return accuracy_and_f1(multitask_outcomes(df, tasks, threshold, label, scores))


def _cumulative(df: DataFrame, score: str, label: str, ranges: int | None) -> DataFrame:
    """Per distinct score: positives and negatives at it and strictly above it, and of all scores.

    Scores are counted first, and the counts ordered by ranges.  Rows whose score is null or NaN, or whose label is
    null, have no place in the order and are left out.
    """
    counts = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("score")
    ).agg(
        F.sum((F.col(label) > 0).cast("bigint")).alias("pos"), F.sum((F.col(label) <= 0).cast("bigint")).alias("neg")
    )
    sums = sums_by_ranges(counts, ["score"], {"pos": "pos", "neg": "neg"}, descending=True, ranges=ranges)
    return sums.withColumnsRenamed({"pos_before": "pos_above", "neg_before": "neg_above"})


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score, the rate at or above it."""
    c = _cumulative(df, score, label, ranges)
    return c.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), "neg_total").alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), "pos_total").alias("tpr"),
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties one half; null with one class only."""
    c = _cumulative(df, score, label, ranges)
    pairs = F.col("neg").cast("double") * (F.col("pos_above") + F.col("pos") / 2)
    total = F.max("pos_total").cast("double") * F.max("neg_total")
    return c.agg(F.when(total > 0, F.sum(pairs) / total).alias("auc"))


def reconstruction_mse(df: DataFrame, predicted: str = "predicted", target: str = "target") -> DataFrame:
    """Mean squared error over all cells of all windows."""
    cells = F.zip_with(
        F.flatten(predicted), F.flatten(target), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    )
    return df.select(cells.alias("_cells")).select(
        F.aggregate("_cells", F.lit(0.0), lambda s, v: s + v).alias("_sum"), F.size("_cells").alias("_n")
    ).agg((F.sum("_sum") / F.sum("_n")).alias("mse"), F.sum("_n").alias("n_values"))


def prediction_distribution(df: DataFrame, names: Sequence[str], predicted: str = "predicted") -> DataFrame:
    from stridelake.operators.joins import decode_labels

    counts = df.groupBy(predicted).agg(F.count(F.lit(1)).alias("n_rows"))
    return decode_labels(counts, names, predicted)
