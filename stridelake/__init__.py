"""Wearable-sensor recordings on Spark: align, resample, window, label, score, evaluate.

Everything is a function from DataFrames to DataFrames.  Nothing here starts a
session or sets a configuration.
"""

from stridelake.stream import Stream

__all__ = ["Stream"]
