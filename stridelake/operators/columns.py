"""Projections, filters and reshapes of sample rows and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.stream import require_columns

# Channel names of the two-sensor log and of window sets.
AXES = ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")
MAG_AXES = ("mag_x", "mag_y", "mag_z")
# Metres per second squared in one g, as the two kinds of source state it.
G_EXACT = 9.80665
G_SHORT = 9.8


def select_channels(
    df: DataFrame, channels: Sequence[str] | None, expected: int | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``keep`` and then ``channels``, in this order; None takes every column."""
    names = [c for c in df.columns if c not in keep] if channels is None else list(channels)
    require_columns(df, [*keep, *names])
    if expected is not None and len(names) != expected:
        raise ValueError(f"expected {expected} channels, got {len(names)}: {names}")
    return df.select(*keep, *names)


def preset_channels(side: str = "generic", count: int = 6) -> list[str]:
    """Names of the six accelerometer and gyroscope channels of a sensor position."""
    if count != len(AXES):
        raise ValueError(f"no preset has {count} channels; name them")
    if side == "generic":
        return list(AXES)
    if side in ("left", "right"):
        return [f"{side}_{axis}" for axis in AXES]
    raise ValueError(f"unknown side {side!r}")


def default_channels(count: int) -> list[str]:
    """Names for a window of ``count`` channels, numbered when no convention fits."""
    if count == len(AXES):
        return list(AXES)
    if count == len(AXES) + len(MAG_AXES):
        return [*AXES, *MAG_AXES]
    return [f"feature_{i}" for i in range(count)]


def average_sensors(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Replace each pair of channels with its mean: ``{output: (left, right)}``."""
    used = [c for pair in pairs.values() for c in pair]
    require_columns(df, used)
    return df.select(
        *[c for c in df.columns if c not in used],
        *[((F.col(a) + F.col(b)) * F.lit(0.5)).alias(name) for name, (a, b) in pairs.items()],
    )


def scale_channels(df: DataFrame, channels: Sequence[str], factor: float) -> DataFrame:
    require_columns(df, channels)
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in channels})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def filter_labels(
    df: DataFrame, column: str, values: Sequence | DataFrame | None = None, at_most: float | None = None
) -> DataFrame:
    """Keep rows whose label is in ``values`` (a list, or a table for many), or is at most a bound."""
    require_columns(df, [column])
    if isinstance(values, DataFrame):
        df = df.join(values.select(column).distinct(), column, "left_semi")
    elif values is not None:
        df = df.filter(F.col(column).isin(list(values)))
    return df if at_most is None else df.filter(F.col(column) <= F.lit(at_most))


# Ids and names of the two-way speed label.
SPEED_LABELS = {"zero": (1, "speed_zero"), "nonzero": (8, "speed_nonzero")}


def threshold_label(df: DataFrame, column: str) -> DataFrame:
    """Label rows by whether ``column`` is exactly zero."""
    still = F.col(column) == 0
    zero, nonzero = SPEED_LABELS["zero"], SPEED_LABELS["nonzero"]
    return df.withColumns(
        {
            "label_id": F.when(still, F.lit(zero[0])).otherwise(F.lit(nonzero[0])),
            "label_text": F.when(still, F.lit(zero[1])).otherwise(F.lit(nonzero[1])),
        }
    )


# Fixed values of position_groups: columns of a position's block, and where its channels stand in it.
def position_groups(
    columns: Sequence[str], positions: int, stride: int = 14, offsets: Sequence[int] = (1, 2, 3, 7, 8, 9, 10, 11, 12)
) -> list[list[str]]:
    """Column names of each body position in a table that lays positions side by side."""
    return [[columns[o + stride * p] for o in offsets] for p in range(positions)]


def unpivot_positions(df: DataFrame, groups: Sequence[Sequence[str]], channels: Sequence[str]) -> DataFrame:
    """One row per sensor position; the channels of a position stay together."""
    require_columns(df, [c for g in groups for c in g])
    if any(len(g) != len(channels) for g in groups):
        raise ValueError("every group needs one column per channel")
    used = {c for g in groups for c in g}
    rest = [c for c in df.columns if c not in used]
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("position"), *[F.col(c).alias(name) for c, name in zip(g, channels)])
            for i, g in enumerate(groups)
        ]
    )
    return df.select(*rest, F.explode(parts).alias("_part")).select(
        *rest, "_part.position", *[f"_part.{c}" for c in channels]
    )


def truncate_channels(df: DataFrame, count: int, data: str = "data") -> DataFrame:
    """Keep the first ``count`` channels of each step; a narrower window fails the query."""
    step = F.col(data)[0]
    narrow = F.concat(F.lit(f"window needs {count} channels, has "), F.size(step).cast("string"))
    cut = F.transform(data, lambda row: F.slice(row, 1, count))
    return df.withColumn(data, F.when(F.size(step) < count, F.raise_error(narrow)).otherwise(cut))


def flatten_steps(df: DataFrame, channels: Sequence[str], data: str = "data") -> DataFrame:
    """Windows in array form to one row per step, one column per channel."""
    rest = [c for c in df.columns if c != data]
    return df.select(*rest, F.posexplode(data).alias("step", "_row")).select(
        *rest, "step", *[F.col("_row")[i].alias(c) for i, c in enumerate(channels)]
    )


def flatten_window(df: DataFrame, data: str = "data", out: str = "features") -> DataFrame:
    """Windows in array form to one row-major vector each."""
    return df.withColumn(out, F.flatten(data)).drop(data)


def union_samples(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def reshape_vector(column: str | Column, steps: int, channels: int) -> Column:
    """A flat vector as ``steps`` rows of ``channels`` doubles."""
    vector = F.col(column) if isinstance(column, str) else column
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.transform(F.slice(vector, i * channels + 1, F.lit(channels)), lambda v: v.cast("double")),
    )
