"""Logged recordings to activity predictions, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from stridelake.functions.batch import score
from stridelake.operators.columns import average_sensors, preset_channels, select_channels
from stridelake.operators.joins import decode_labels
from stridelake.operators.metrics import decide
from stridelake.operators.scoring import score_windows
from stridelake.operators.windows import assemble_windows, sliding_windows
from stridelake.stream import Stream


def sensor_channels(samples: DataFrame, stream: Stream, sensor: str, channels: Sequence[str] | None = None) -> DataFrame:
    """The channels to score: named ones, those of one side, or the mean of both sides."""
    keep = stream.columns
    if channels is not None:
        return select_channels(samples, channels, keep=keep)
    if sensor == "average":
        pairs = {axis: (f"left_{axis}", f"right_{axis}") for axis in preset_channels("generic")}
        return average_sensors(select_channels(samples, [c for p in pairs.values() for c in p], keep=keep), pairs)
    return select_channels(samples, preset_channels(sensor), expected=6, keep=keep)


def log_windows(samples: DataFrame, stream: Stream, size: int, hop: int) -> DataFrame:
    """Windows in array form over all columns that are not part of the order."""
    channels = [c for c in samples.columns if c not in stream.columns]
    long = sliding_windows(samples, stream, size, hop)
    return assemble_windows(long, [*stream.keys, "window_no"], channels)


def predict_log(
    samples: DataFrame, stream: Stream, names: Sequence[str], encoder: Mapping[str, np.ndarray],
    classifier: Mapping[str, np.ndarray], sensor: str = "left", channels: Sequence[str] | None = None, size: int = 20,
    hop: int = 20, batch: int = 128,
) -> DataFrame:
    """``keys, window_no, scores, predicted, name`` for every window of every recording."""
    chosen = sensor_channels(samples, stream, sensor, channels)
    width = len(chosen.columns) - len(stream.columns)
    scored = score_windows(log_windows(chosen, stream, size, hop), encoder, classifier, channels=width, batch=batch)
    return decode_labels(scored, names, "predicted")


def predict_log_with(
    samples: DataFrame, stream: Stream, names: Sequence[str], fn: Callable[[np.ndarray], np.ndarray],
    channels: Sequence[str] | None = None, sensor: str = "left", size: int = 20, hop: int = 20, batch: int = 128,
) -> DataFrame:
    """:func:`predict_log` with any function from windows (B, W, F) to scores (B, classes)."""
    windows = log_windows(sensor_channels(samples, stream, sensor, channels), stream, size, hop)
    return decode_labels(decide(score(windows, fn, batch=batch)), names, "predicted")
