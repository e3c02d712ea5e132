"""Count windows, gap sessions and label runs.

A window in long form is the rows ``keys, window_no, step``; row numbers decide
membership by arithmetic, so cutting windows adds no shuffle to the numbering.
Only :func:`assemble_windows` groups, by window, and a group has ``size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.operators.ordered import mark_runs, numbered
from stridelake.operators.resample import _div
from stridelake.stream import Stream, require_columns


def _positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def _spread(rows: DataFrame, seq: Column, n: Column, size: int, hop: int) -> DataFrame:
    """Rows to the windows that hold them; recordings shorter than one window have none."""
    big = [F.lit(v).cast("bigint") for v in (size, hop)]
    lo = F.greatest(F.lit(0).cast("bigint"), _div(seq - big[0] + big[1], hop))
    lo = F.when(seq < size, F.lit(0).cast("bigint")).otherwise(lo)
    hi = F.least(_div(seq, hop), _div(n - size, hop))
    # The filter comes first: a falling pair of bounds would make sequence() count down.
    fitting = rows.filter(n >= size).withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    return fitting.withColumn("window_no", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def sliding_windows(df: DataFrame, stream: Stream, size: int, hop: int) -> DataFrame:
    """Windows of ``size`` rows starting every ``hop`` rows; a partial tail is left out.

    Adds ``window_no``, ``step`` and ``start_seq``.
    """
    _positive(size=size, hop=hop)
    rows = numbered(df, stream)
    start = F.col("window_no") * hop
    return (
        _spread(rows, F.col("seq"), F.col("n"), size, hop)
        .withColumns({"step": (F.col("seq") - start).cast("int"), "start_seq": start})
        .drop("seq", "n")
    )


def tumbling_windows(df: DataFrame, stream: Stream, size: int, min_rows: int | None = None) -> DataFrame:
    """Windows side by side, the tail left out; recordings below ``min_rows`` give none.

    ``min_rows=size + 1`` is the strict rule of sources that drop a recording of
    exactly one window.
    """
    _positive(size=size)
    rows = numbered(df, stream).filter(F.col("n") >= (size if min_rows is None else min_rows))
    window_no = _div(F.col("seq"), size)
    return (
        rows.withColumn("window_no", window_no)
        .filter((F.col("window_no") + 1) * size <= F.col("n"))
        .withColumns(
            {"step": (F.col("seq") - F.col("window_no") * size).cast("int"), "start_seq": F.col("window_no") * size}
        )
        .drop("seq", "n")
    )


def assemble_windows(
    long: DataFrame, keys: Sequence[str], channels: Sequence[str], first: Sequence[str] = (), data: str = "data"
) -> DataFrame:
    """Long form to array form, one row per window; ``first`` columns come from step 0."""
    row = F.array(*[F.col(c).cast("float") for c in channels])
    steps = F.array_sort(F.collect_list(F.struct("step", row.alias("row"))))
    return long.groupBy(*keys).agg(
        F.transform(steps, lambda s: s["row"]).alias(data),
        *[F.min_by(c, "step").alias(c) for c in first],
    )


def gap_sessions(df: DataFrame, stream: Stream, gap: int) -> DataFrame:
    """Runs of rows less than ``gap`` apart: adds ``run_id``, ``run_start``, ``run_pos``, ``seq``, ``n``."""
    t = stream.time
    return mark_runs(df, stream, lambda prev, cur: F.abs(cur(t) - prev(t)) >= gap)


def contiguous_windows(
    df: DataFrame, stream: Stream, size: int, hop: int, gap: int, label: str, channels: Sequence[str] = ()
) -> DataFrame:
    """Windows inside one gap-free run with one label; a step without a label agrees with none.

    Starts are multiples of ``hop`` in the recording, not in the run, and lie
    before its last row.  The label is shifted to begin at zero.
    """
    _positive(size=size, hop=hop)
    rows = gap_sessions(df.select(*dict.fromkeys([*stream.columns, label, *channels])), stream, gap)
    spread = _spread(rows, F.col("seq"), F.col("n"), size, hop).filter(
        F.col("window_no") * hop < F.col("n") - 1
    )
    spread = spread.withColumn("step", (F.col("seq") - F.col("window_no") * hop).cast("int"))
    merged = spread.groupBy(*stream.keys, "window_no").agg(
        F.min("run_id").alias("_run_lo"), F.max("run_id").alias("_run_hi"),
        F.min(label).alias("_label_lo"), F.max(label).alias("_label_hi"), F.count(label).alias("_labelled"), F.count(F.lit(1)).alias("_rows"),
        F.min(stream.time).alias("start_t"), F.max(stream.time).alias("end_t"),
        *(
            [
                F.transform(
                    F.array_sort(F.collect_list(F.struct("step", F.array(*channels).alias("row")))), lambda s: s["row"]
                ).alias("data")
            ]
            if channels
            else []
        ),
    )
    return merged.filter("_run_lo = _run_hi and _label_lo = _label_hi and _labelled = _rows").select(
        *stream.keys, "window_no", (F.col("window_no") * hop).alias("start_seq"), "start_t", "end_t",
        (F.col("_label_lo") - 1).alias(label), *(["data"] if channels else []),
    )


def merge_window_labels(
    long: DataFrame, keys: Sequence[str], label: str, mode: str = "all", flag: str | None = None,
    lowest: str | None = None,
) -> DataFrame:
    """One label per window of long-form rows.

    ``all``    windows with one distinct label on every step; with ``flag``, all
               windows and whether they have one
    ``any``    all windows: 0 when no label is above 0, else the only label, else
               the second smallest
    ``first``  all windows with the label of the first step

    ``lowest`` adds the smallest label of the window's steps.
    """
    if mode not in ("all", "any", "first"):
        raise ValueError("mode is all, any or first")
    require_columns(long, [*keys, label, "step"])
    low = F.min(label).alias("_lo")
    kept = F.lit(True)
    if mode == "first":
        merged = long.groupBy(*keys).agg(F.min_by(label, "step").alias(label), low)
    elif mode == "all":
        merged = long.groupBy(*keys).agg(F.min(label).alias(label), F.max(label).alias("_hi"), F.count("*").alias("_rows"), F.count(label).alias("_labelled"), low)
        kept = F.coalesce((F.col(label) == F.col("_hi")) & (F.col("_rows") == F.col("_labelled")), F.lit(False))
        if flag is None:
            merged = merged.filter(kept)
    else:
        seen = F.array_sort(F.collect_set(label)).alias("_seen")  # at most one entry per step
        merged = long.groupBy(*keys).agg(seen, low).withColumn(label, any_label("_seen"))
    extra = [kept.alias(flag)] if flag is not None else []
    return merged.select(*keys, label, *extra, *([F.col("_lo").alias(lowest)] if lowest is not None else []))


def any_label(seen: str) -> Column:
    """The label of a window from its distinct labels in order; see :func:`merge_window_labels`."""
    return (
        F.when(F.array_max(seen) <= 0, F.lit(0))
        .when(F.size(seen) == 1, F.get(seen, F.lit(0)))
        .otherwise(F.get(seen, F.lit(1)))
    )


def subwindows(long: DataFrame, window: str, size: int, piece: int) -> DataFrame:
    """Cut windows of ``size`` steps into pieces of ``piece`` steps, in order."""
    _positive(size=size, piece=piece)
    if size % piece:
        raise ValueError(f"pieces of {piece} steps do not fill windows of {size}")
    pieces = size // piece
    return long.withColumns(
        {
            "piece_id": F.col(window) * pieces + _div(F.col("step").cast("bigint"), piece),
            "step": F.pmod("step", F.lit(piece)).cast("int"),
        }
    )


def split_window_array(df: DataFrame, size: int, piece: int, data: str = "data") -> DataFrame:
    """:func:`subwindows` for windows in array form; adds ``piece_no``."""
    if size % piece:
        raise ValueError(f"pieces of {piece} steps do not fill windows of {size}")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(size // piece - 1)), lambda i: F.slice(F.col(data), i * piece + 1, piece)
    )
    rest = [c for c in df.columns if c != data]
    return df.select(*rest, F.posexplode(parts).alias("piece_no", data))


def activity_runs(df: DataFrame, stream: Stream, label: str, activity=None) -> DataFrame:
    """Runs of neighbouring rows (or windows) with one label: first and last seq, length."""
    rows = mark_runs(
        df.select(*dict.fromkeys([*stream.columns, label])),
        stream,
        lambda prev, cur: ~cur(label).eqNullSafe(prev(label)),
        uses=[label],
    )
    if activity is not None:
        rows = rows.filter(F.col(label) == activity)
    # Rows of a run are combined before the shuffle.
    return rows.groupBy(*stream.keys, "run_id", label).agg(
        F.min("seq").alias("start_seq"), (F.max("seq") + 1).alias("end_seq"), F.count(F.lit(1)).alias("n_rows")
    )


def first_run(df: DataFrame, stream: Stream, label: str, activity) -> DataFrame:
    """The first run of an activity in each recording; a recording without one has no row."""
    return activity_runs(df, stream, label, activity).groupBy(*stream.keys, label).agg(
        F.min("start_seq").alias("start_seq"), F.min_by("end_seq", "start_seq").alias("end_seq")
    )


def chunk_runs(df: DataFrame, stream: Stream, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` rows inside runs of rows marked with ``run_start`` and ``run_pos``.

    Needs the columns of :func:`~stridelake.operators.ordered.mark_runs`.  Adds
    ``window_no`` (within the run) and ``step``.
    """
    _positive(size=size)
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    require_columns(df, [*stream.keys, "run_id", "run_pos"])
    hop = size - overlap
    big = F.lit(hop).cast("bigint")
    hi = _div(F.col("run_pos"), hop)
    lo = F.when(F.col("run_pos") < size, F.lit(0).cast("bigint")).otherwise(
        _div(F.col("run_pos") - size + big, hop)
    )
    spread = df.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    spread = spread.withColumn("window_no", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return spread.withColumn("step", (F.col("run_pos") - F.col("window_no") * hop).cast("int"))


def full_windows(long: DataFrame, keys: Sequence[str], size: int, *aggregates: Column) -> DataFrame:
    """Aggregate windows and keep those that reached ``size`` rows."""
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggregates).filter(
        F.col("_rows") == size
    ).drop("_rows")


def snippet(df: DataFrame, window: str, start: int, count: int, data: str = "data", size: int | None = None) -> DataFrame:
    """Up to ``count`` consecutive windows as one series: ``position`` and the step's values."""
    chosen = df.filter((F.col(window) >= start) & (F.col(window) < start + count))
    steps = chosen.select(window, F.size(data).alias("_size"), F.posexplode(data).alias("step", "row"))
    width = F.lit(size) if size is not None else F.col("_size")
    return steps.select(
        ((F.col(window) - start) * width + F.col("step")).cast("bigint").alias("position"), window, "step", "row"
    )


def head_window(df: DataFrame, stream: Stream, size: int) -> DataFrame:
    """The first ``size`` rows of each recording that has as many; adds ``step``."""
    rows = numbered(df, stream)
    return rows.filter((F.col("n") >= size) & (F.col("seq") < size)).withColumn(
        "step", F.col("seq").cast("int")
    ).drop("seq", "n")


def map_windows(df: DataFrame, fn, schema: str, data: str = "data") -> DataFrame:
    """Apply ``fn(ndarray W x F) -> ndarray`` to every window; ``schema`` types the result.

    Windows may differ in shape, so ``fn`` is called for each, and a null window
    stays null.  Windows of one shape go faster through ``functions.batch.score``.
    """
    @F.pandas_udf(schema)
    def apply(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None else np.asarray(fn(np.stack(w).astype("float64"))).tolist())

    return df.withColumn(data, apply(F.col(data)))
