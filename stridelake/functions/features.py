"""Feature functions on windows in array form (``ARRAY<ARRAY<..>>``, steps by channels)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions.batch import score
from stridelake.operators.sampling import hash_uniform

# Divisor of accelerometer channels, and the guard of magnetometer norms.
ACC_DIVISOR = 9.8
MAG_EPS = 1e-5


def normalize(
    df: DataFrame, channels: int, acc: bool = True, mag: bool = True, gamma: float = 1.0, data: str = "data"
) -> DataFrame:
    """Truncate to ``channels``; scale accelerometer and, with nine channels, magnetometer.

    A step with fewer channels ends the query.
    """

    def step(row: Column) -> Column:
        narrow = F.raise_error(F.concat(F.lit(f"a step has fewer than {channels} channels: "), F.size(row)))
        if channels < 6:
            return F.when(F.size(row) >= channels, F.slice(row, 1, channels)).otherwise(narrow.cast(df.schema[data].dataType.elementType))
        values = [row[i].cast("double") for i in range(channels)]  # fails on a narrower step
        if acc:
            values[:3] = [v / F.lit(ACC_DIVISOR) for v in values[:3]]
        if channels == 9 and mag:
            x, y, z = values[6:9]
            norm = F.sqrt(x * x + y * y + z * z) + F.lit(MAG_EPS)
            values[6:9] = [v / norm * F.lit(float(gamma)) for v in (x, y, z)]
        return F.array(*values)

    return df.withColumn(data, F.transform(data, step))


def mask_count(steps: int, ratio: float) -> int:
    return max(1, round(steps * ratio))


def span_draws(steps: int, goal: int) -> int:
    """Draws allowed for a mask: twice what single steps would need on average, and some more."""
    return 30 + math.ceil(2 * steps * math.log(steps / (steps - goal)))


def span_bounds(max_gram: int, p: float) -> list[float]:
    """Upper bounds in [0, 1) of span lengths 1, 2, ...: the geometric law, cut at ``max_gram``."""
    whole = 1 - (1 - p) ** max_gram
    return [(1 - (1 - p) ** k) / whole for k in range(1, max_gram)]


def span_mask(
    df: DataFrame, key: str, steps: int, ratio: float = 0.15, max_gram: int = 10, p: float = 0.2, seed: int = 0,
    epoch: int = 0, out: str = "pos",
) -> DataFrame:
    """Masked positions in spans: ``out`` holds exactly ``mask_count`` sorted steps.

    Span lengths follow a geometric law cut at ``max_gram``; a span starts at a free step and never covers the last one.
    Draw number j of a window is a hash of seed, epoch, key and j, so it needs no generator and no order of windows; a
    draw whose start is masked already is rejected.  Should ``span_draws`` of them not fill the mask, the free steps with
    the smallest hashes do.  ``key`` is of any type that can be written as text.
    """
    if steps < 2:
        raise ValueError("a window needs two steps: the last is never masked")
    goal = mask_count(steps, ratio)
    if goal > steps - 1:
        raise ValueError("more positions asked for than may be masked")
    bounds = F.array(*[F.lit(b) for b in span_bounds(max_gram, p)]) if max_gram > 1 else F.array().cast("array<double>")

    def draw(what: str, j: Column) -> Column:
        return hash_uniform(seed, F.lit(f"{epoch}:{what}"), F.col(key), j)

    def take(masked: Column, j: Column) -> Column:
        start = F.floor(draw("start", j) * steps).cast("int")
        length = F.size(F.filter(bounds, lambda b: b <= draw("length", j))) + 1
        end = F.least(start + F.least(length, F.lit(goal) - F.size(masked)), F.lit(steps - 1))
        fits = ~F.array_contains(masked, start) & (end > start)
        return F.when((F.size(masked) < goal) & fits, F.array_union(masked, F.sequence(start, end - 1))).otherwise(masked)

    none = F.array().cast("array<int>")
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(span_draws(steps, goal) - 1)), none, take)
    free = F.filter(F.sequence(F.lit(0), F.lit(steps - 2)), lambda i: ~F.array_contains("_drawn", i))
    tickets = F.array_sort(F.transform(free, lambda i: F.struct(draw("rest", i).alias("h"), i.alias("i"))))
    rest = F.transform(F.slice(tickets, F.lit(1), F.lit(goal) - F.size("_drawn")), lambda t: t["i"])
    full = F.when(F.size("_drawn") < goal, F.concat("_drawn", rest)).otherwise(F.col("_drawn"))
    return df.withColumn("_drawn", drawn).withColumn(out, F.array_sort(full)).drop("_drawn")


def random_mask(df: DataFrame, key: str, steps: int, count: int, seed: int = 0, out: str = "pos") -> DataFrame:
    """``count`` different steps, the ones with the smallest hash, in step order."""
    if not 1 <= count <= steps:
        raise ValueError("count is 1 to steps")

    def ticket(i: Column) -> Column:
        text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), i.cast("string"))
        return F.struct(F.md5(text).alias("h"), i.alias("i"))

    tickets = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), ticket))
    chosen = F.transform(F.slice(tickets, 1, count), lambda t: t["i"])
    return df.withColumn(out, F.array_sort(chosen))


def apply_mask(
    df: DataFrame, key: str, mask_prob: float = 0.8, replace_prob: float = 0.0, seed: int = 0, data: str = "data",
    pos: str = "pos", out: str = "masked", channels: str | None = None,
) -> DataFrame:
    """Blank the masked steps of a window, or fill them with noise, or leave them.

    The two draws are independent per window: noise has probability
    ``(1 - mask_prob) * replace_prob``.  With ``channels``, single cells are masked:
    the channel at a place of that array goes with the step at that place of ``pos``.
    """
    blank = hash_uniform(seed, F.lit("mask"), key) < mask_prob
    noisy = hash_uniform(seed, F.lit("replace"), key) < replace_prob

    wide = "array<double>"

    def cell(i: Column, c: Column, v: Column) -> Column:
        return F.when(blank, F.lit(0.0)).when(noisy, hash_uniform(seed, F.lit("noise"), key, i, c)).otherwise(v.cast("double"))

    if channels is None:
        # A step that is not masked goes through whole; only the cells of masked ones are looked at.
        changed = F.transform(data, lambda row, i: F.when(
            F.array_contains(F.col(pos), i), F.transform(row, lambda v, c: cell(i, c, v))).otherwise(row.cast(wide)))
    else:
        cells = F.arrays_zip(F.col(pos).alias("step"), F.col(channels).alias("channel"))

        def masked_row(row: Column, i: Column) -> Column:
            own = F.transform(F.filter(cells, lambda p: p["step"] == i), lambda p: p["channel"])
            return F.transform(row, lambda v, c: F.when(F.array_contains(own, c), cell(i, c, v)).otherwise(v.cast("double")))

        changed = F.transform(data, lambda row, i: F.when(F.array_contains(F.col(pos), i), masked_row(row, i)).otherwise(row.cast(wide)))
    return df.withColumn(out, F.when(blank | noisy, changed).otherwise(F.col(data).cast(f"array<{wide}>")))


def gather(df: DataFrame, data: str = "data", pos: str = "pos", channels: str | None = None, out: str = "target") -> DataFrame:
    """Steps at the masked positions, in their order; with ``channels``, single cells."""
    if channels is None:
        picked = F.transform(pos, lambda i: F.get(F.col(data), i))
    else:
        picked = F.zip_with(pos, channels, lambda i, c: F.get(F.get(F.col(data), i), c))
    return df.withColumn(out, picked)


def spectrum(df: DataFrame, n: int = 10, data: str = "data", out: str = "spectrum") -> DataFrame:
    """Discrete Fourier transform over time, per channel, cut or zero-padded to ``n`` steps.

    ``out`` replaces ``data``: ``n`` rows of magnitudes, then ``n`` rows of phases.
    The imaginary part of bin 0, and of bin ``n / 2``, is exactly zero.
    """
    turns = np.outer(np.arange(n), np.arange(n)) % n
    angle = 2 * np.pi * turns / n
    cos, sin = np.cos(angle), np.where(2 * turns % n == 0, 0.0, np.sin(angle))

    def transform(x: np.ndarray) -> np.ndarray:
        steps = min(n, x.shape[1])
        re = cos[:, :steps] @ x[:, :steps]
        # 0 - x, not -x: minus zero would turn the angle of a negative number round.
        im = 0.0 - sin[:, :steps] @ x[:, :steps]
        return np.concatenate([np.hypot(re, im), np.arctan2(im, re)], axis=1)

    return score(df, transform, data, out, rank=2, batch=4096, dtype="float64")


def profile(df: DataFrame, data: str = "data") -> DataFrame:
    """Shape and moments of a window set, empty windows included; the standard deviation is that of the population."""
    values = df.select(
        F.coalesce(F.size(data), F.lit(0)).alias("steps"), F.size(F.get(F.col(data), F.lit(0))).alias("channels"),
        F.posexplode_outer(F.flatten(data)).alias("place", "v"),
    )
    value = F.col("v").cast("double")
    return values.agg(
        F.count(F.when(F.coalesce(F.col("place"), F.lit(0)) == 0, True)).alias("n_windows"),
        F.max("steps").cast("bigint").alias("n_steps"),
        F.max("channels").cast("bigint").alias("n_channels"),
        F.count("place").alias("n_values"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("std_value"),
    )


def feature_chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply window transforms one after another; the plan stays one projection where they allow it."""
    return reduce(lambda frame, step: frame.transform(step), steps, df)


def mean_pool(df: DataFrame, width: int, data: str = "data", out: str = "pooled") -> DataFrame:
    """Average of a window's steps, per channel."""
    across = F.sequence(F.lit(0), F.lit(width - 1))
    total = F.transform(
        across,
        lambda c: F.aggregate(data, F.lit(0.0), lambda s, row: s + F.get(row, c).cast("double")) / F.size(data),
    )
    return df.withColumn(out, total)
