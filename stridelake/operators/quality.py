"""Checks of recordings and windows: violations come back as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.stream import Stream, require_columns


def _raise_if_any(violations: DataFrame, strict: bool) -> DataFrame:
    if strict:
        sample = violations.limit(5).collect()
        if sample:
            raise ValueError(f"violations found, first: {sample}")
    return violations


def validate_samples(df: DataFrame, stream: Stream, window: int | None = None, strict: bool = False) -> DataFrame:
    """``keys, check, found``: recordings that are too short or whose time stands still.

    ``two_rows``, ``two_increasing_times``, ``one_window`` (with ``window``), and
    ``no_place``: rows without identity or time, which no operator uses.
    """
    if window is not None and window <= 0:
        raise ValueError("window must be positive")
    require_columns(df, stream.columns)
    keys = list(stream.keys)
    unplaced = F.lit(False)
    for c in (*keys, stream.time):
        unplaced = unplaced | F.col(c).isNull()
    rows = df.select(*keys, stream.time, unplaced.alias("_unplaced"))
    # The time leads the order, so it rises somewhere unless its bounds are equal.
    checked = rows.filter("not _unplaced").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(stream.time).alias("_first"), F.max(stream.time).alias("_last")
    )
    checks = [
        ("two_rows", F.col("n") < 2, F.col("n")),
        ("two_increasing_times", F.col("_first") == F.col("_last"), F.lit(1).cast("bigint")),
    ]
    if window is not None:
        checks.append(("one_window", F.col("n") < window, F.col("n")))
    found = F.array(
        *[F.when(bad, F.struct(F.lit(name).alias("check"), value.alias("found"))) for name, bad, value in checks]
    )
    short = checked.select(*keys, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("_f")).select(
        *keys, "_f.check", "_f.found"
    )
    lost = rows.filter("_unplaced").groupBy(*keys).agg(F.count(F.lit(1)).alias("found")).select(
        *keys, F.lit("no_place").alias("check"), "found"
    )
    return _raise_if_any(short.unionByName(lost), strict)


def validate_windows(
    df: DataFrame, key: str, steps: int, channels: int, dimension: int | None = None, data: str = "data",
    strict: bool = False,
) -> DataFrame:
    """``key, check, found`` for windows of another shape; more channels than the set has is an error at once."""
    if steps <= 0 or channels <= 0:
        raise ValueError("steps and channels must be positive")
    if dimension is not None and channels > dimension:
        raise ValueError(f"{channels} channels asked for, the window set has {dimension}")
    n_steps = F.coalesce(F.size(data), F.lit(0))
    widths = F.transform(data, lambda row: F.size(row))
    narrow = F.coalesce(F.array_min(widths), F.lit(0))
    found = F.array(
        F.when(n_steps != steps, F.struct(F.lit("steps").alias("check"), n_steps.cast("bigint").alias("found"))),
        F.when(narrow < channels, F.struct(F.lit("channels").alias("check"), narrow.cast("bigint").alias("found"))),
        F.when(
            F.array_max(widths) != narrow, F.struct(F.lit("ragged").alias("check"), F.array_max(widths).cast("bigint").alias("found"))
        ),
    )
    bad = df.select(key, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("_f")).select(
        key, "_f.check", "_f.found"
    )
    return _raise_if_any(bad, strict)


#: Ids of one bitmap.
BITMAP_IDS = 32_768


def summary_metrics(labels: Sequence[str] = (), data: str = "data") -> list[Column]:
    """Aggregates for ``DataFrame.observe`` on a job that writes windows, so that a summary costs no second read.

    Empty and null windows count, with no steps.  Ids of a label kind from 0 to ``BITMAP_IDS`` - 1 are bits of one
    bitmap; rows with an id outside are counted, and :func:`label_ids` finds those of any range.
    """
    metrics = [
        F.count(F.lit(1)).alias("n_windows"), F.max(F.coalesce(F.size(data), F.lit(0))).cast("bigint").alias("n_steps"),
        F.max(F.size(F.get(F.col(data), F.lit(0)))).cast("bigint").alias("n_channels"),
    ]
    for c in labels:
        held = F.when(F.col(c).between(0, BITMAP_IDS - 1), F.col(c).cast("bigint") + 1)
        outside = F.when(F.col(c).isNotNull() & held.isNull(), True)
        metrics += [F.bitmap_construct_agg(F.bitmap_bit_position(held)).alias(f"{c}_bits"), F.count(outside).alias(f"{c}_outside")]
    return metrics


def summary_from(seen: dict, labels: Sequence[str] = ()) -> dict:
    """The observed numbers with ``<kind>_ids``, sorted lists, in place of bitmaps."""
    found = {c: seen[c] for c in ("n_windows", "n_steps", "n_channels")}
    for c in labels:
        bits = bytes(seen[f"{c}_bits"] or b"")
        found[f"{c}_ids"] = [8 * i + k for i, byte in enumerate(bits) for k in range(8) if byte >> k & 1]
        found[f"{c}_outside"] = seen[f"{c}_outside"]
    return found


def label_ids(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``kind, id``: the ids that occur, for kinds of any number of ids.

    Ids are gathered map-side as bitmaps of ``BITMAP_IDS``, a row per bitmap; no list holds a kind's ids.
    """
    require_columns(df, labels)
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("bigint").alias("id")) for c in labels])
    rows = df.select(F.explode(pairs).alias("_p")).select("_p.*").filter("id is not null")
    first = F.col("id") - F.pmod(F.col("id"), F.lit(BITMAP_IDS))
    maps = rows.withColumn("_first", first).groupBy("kind", "_first").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("id") - F.col("_first") + 1)).alias("_bits"))
    bytes_ = F.sequence(F.lit(1), F.length("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.col("_byte"), F.lit(1))), 16, 10).cast("int")
    set_ = maps.select("kind", "_first", "_bits", F.explode(bytes_).alias("_byte")).select("kind", "_first", "_byte", byte.alias("_value")).filter("_value > 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("_value").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)
    return set_.select("kind", "_first", "_byte", F.explode(places).alias("_k")).select(
        "kind", (F.col("_first") + (F.col("_byte") - 1) * 8 + F.col("_k")).cast("bigint").alias("id"))


def summarize_windows(df: DataFrame, labels: Sequence[str] = (), data: str = "data") -> DataFrame:
    """One row for windows that are there already: number and shape and, per label kind, how many ids occur."""
    shape = summary_metrics((), data)
    whole = df.agg(*shape)
    if not labels:
        return whole
    counts = label_ids(df, labels).groupBy().pivot("kind", list(labels)).agg(F.count("id"))
    return whole.join(counts.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(f"{c}_count") for c in labels]), how="cross")


def first_rows(df: DataFrame, key: str, count: int = 3) -> DataFrame:
    """A preview: the first windows by key."""
    return df.orderBy(key).limit(count)
