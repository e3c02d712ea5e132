"""Windows to classifier input: split, cut, merge labels, sample the train part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators.labels import zero_base
from stridelake.operators.sampling import assign_split, balanced_cuts, labelled_flag, split, with_balanced_flag
from stridelake.operators.windows import merge_window_labels, subwindows
from stridelake.sources.folders import stored


def _sample_train(pieces: DataFrame, rate: float, balance: bool, seed: int) -> DataFrame:
    """``labelled`` for the train part; the other parts keep all their labels."""
    train = pieces.filter("split = 'train'")
    if balance:
        chosen = with_balanced_flag(pieces, balanced_cuts(train, "piece_id", "label", rate, seed), "piece_id", "label", seed, "_chosen")
    else:
        chosen = pieces.withColumn("_chosen", labelled_flag(train, "piece_id", rate, seed))
    return chosen.withColumn("labelled", F.when(F.col("split") == "train", F.col("_chosen")).otherwise(F.lit(True))).drop("_chosen")


def prepare_classifier_data(
    windows: DataFrame, key: str, label: str, size: int, piece: int, label_rate: float, balance: bool, seed: int,
    train: float = 0.8, vali: float = 0.1,
) -> DataFrame:
    """Windows in array form with one label each: ``piece_id, split, label, labelled, data``.

    The parts are drawn over windows, so pieces of a window stay in one part.  Parts
    and flags are decided on a stored table of keys and labels; the arrays are read
    once, joined to their window's decisions and cut.
    """
    if size % piece:
        raise ValueError(f"pieces of {piece} steps do not fill windows of {size}")
    count = size // piece
    parts = stored(split(zero_base(windows.select(key, F.col(label).alias("label")), ["label"]), key, seed, train, vali), "parts")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("piece_no")
    pieces = parts.select(key, "label", "split", numbers).withColumn("piece_id", F.col(key) * count + F.col("piece_no"))
    decided = _sample_train(pieces, label_rate, balance, seed).groupBy(key).agg(
        F.first("split").alias("split"), F.first("label").alias("label"),
        F.collect_list(F.struct("piece_no", "piece_id", "labelled")).alias("_pieces"),  # one entry per piece of the window
    )
    joined = windows.select(key, "data").join(decided, key).withColumn("_piece", F.explode("_pieces"))
    return joined.select("_piece.piece_id", "split", "label", "_piece.labelled",
                         F.slice("data", F.col("_piece.piece_no") * piece + 1, F.lit(piece)).alias("data"))


def prepare_label_windows(
    long: DataFrame, key: str, label: str, size: int, piece: int, label_rate: float, balance: bool, seed: int,
    train: float = 0.8, vali: float = 0.1, mode: str = "all",
) -> DataFrame:
    """Long-form windows whose steps carry labels: ``piece_id, split, label, labelled``."""
    # Only the "any" rule depends on where labels begin; the others are shifted once they are stored.
    based = zero_base(long, [label]) if mode == "any" else long
    cut = subwindows(based.select(key, "step", label), key, size, piece)
    merged = merge_window_labels(cut, [key, "piece_id"], label, mode, flag="_kept", lowest="_low")
    # Pieces with their labels are narrow and all that the rest reads, several times over.
    pieces = stored(merged.withColumnRenamed(label, "label"), "pieces")
    if mode != "any":
        pieces = pieces.withColumn("label", F.col("label") - pieces.agg(F.min("_low")).scalar())
    ids = pieces.select(key).distinct()
    placed = assign_split(pieces.filter("_kept"), ids, key, seed, train, vali).drop("_kept", "_low", key)
    placed = stored(placed, "parts")
    return _sample_train(placed, label_rate, balance, seed).select("piece_id", "split", "label", "labelled")
