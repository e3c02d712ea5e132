"""Ordered primitives on recordings: numbering, neighbours, runs.

Each one shuffles the samples once, on ``(keys, slice)``, and joins the slice
summary on the same columns, so the join adds no shuffle of the samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.stream import SLICE, Stream, require_columns

Getter = Callable[[str], Column]


def slice_edges(df: DataFrame, stream: Stream, carry: Sequence[str] = ()) -> DataFrame:
    """One row per slice: rows before it, stream length and bounds, rows on either side.

    ``_before`` and ``_after`` are structs of time and ``carry`` from the nearest
    slices that hold rows.
    """
    carry = [c for c in carry if c != stream.time]
    if carry:
        row = F.struct(stream.time, *stream.ties, *[c for c in carry if c not in stream.ties])
        first, last = F.min(row), F.max(row)
    else:
        # Plain numbers stay in the hash aggregation; structs would sort first.
        first, last = F.struct(F.min(stream.time).alias(stream.time)), F.struct(F.max(stream.time).alias(stream.time))
    summary = stream.sliced(df).groupBy(*stream.slice_keys).agg(
        F.count(F.lit(1)).alias("_rows"), first.alias("_first"), last.alias("_last")
    )
    order = stream.across_slices()
    whole = Window.partitionBy(*stream.keys)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *stream.slice_keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_rows").over(whole).alias("_length"),
        F.min(F.col("_first")[stream.time]).over(whole).alias("_t_first"),
        F.max(F.col("_last")[stream.time]).over(whole).alias("_t_last"),
        F.lag("_last").over(order).alias("_before"),
        F.lead("_first").over(order).alias("_after"),
    )


def number_rows(
    df: DataFrame, stream: Stream, seq: str = "seq", length: str = "n", attach: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add the row's 0-based place in its recording and the recording's length.

    ``attach`` is a table with one row per recording; its columns reach the
    samples through the slice summary, so a long recording is not shuffled on
    its keys alone.  ``edges`` is a slice summary that is at hand already: the slice,
    ``_base`` (rows before it) and ``_length`` (rows of its recording).
    """
    sliced = stream.sliced(df)
    if edges is None:
        edges = slice_edges(sliced, stream).select(*stream.slice_keys, "_base", "_length")
    extra = []
    if attach is not None:
        extra = [c for c in attach.columns if c not in stream.keys]
        edges = edges.join(attach, list(stream.keys), "left")
    ranked = sliced.withColumn("_rank", F.row_number().over(stream.in_slice()))
    kept = [c for c in df.columns if c not in (seq, length, SLICE)]
    return ranked.join(edges, stream.slice_keys).select(
        *kept,
        (F.col("_base") + F.col("_rank") - 1).alias(seq),
        F.col("_length").alias(length),
        *extra,
    )


def numbered(df: DataFrame, stream: Stream) -> DataFrame:
    """``df`` itself when it carries ``seq`` and ``n`` already, else numbered."""
    return df if {"seq", "n"} <= set(df.columns) else number_rows(df, stream)


def with_neighbours(df: DataFrame, stream: Stream, carry: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for ``carry``, with ``seq`` and ``n``.

    A null neighbour at the ends of the recording is told apart from a null
    value by ``seq`` (0 or n - 1).
    """
    require_columns(df, carry)
    sliced = stream.sliced(df)
    edges = slice_edges(sliced, stream, carry)
    w = stream.in_slice()
    local = sliced.select(
        *sliced.columns,
        F.row_number().over(w).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy(*stream.slice_keys)).alias("_size"),
        *[F.lag(c).over(w).alias(f"_lag_{c}") for c in carry],
        *[F.lead(c).over(w).alias(f"_lead_{c}") for c in carry],
    )
    kept = [c for c in df.columns if c not in ("seq", "n", SLICE)]
    return local.join(edges, stream.slice_keys).select(
        *kept,
        (F.col("_base") + F.col("_rank") - 1).alias("seq"),
        F.col("_length").alias("n"),
        *[
            F.when(F.col("_rank") > 1, F.col(f"_lag_{c}")).otherwise(F.col("_before")[c]).alias(f"prev_{c}")
            for c in carry
        ],
        *[
            F.when(F.col("_rank") < F.col("_size"), F.col(f"_lead_{c}")).otherwise(F.col("_after")[c]).alias(f"next_{c}")
            for c in carry
        ],
    )


def mark_runs(
    df: DataFrame,
    stream: Stream,
    breaks: Callable[[Getter, Getter], Column],
    uses: Sequence[str] = (),
) -> DataFrame:
    """Cut every recording into runs.

    ``breaks(prev, cur)`` says whether a new run starts between two neighbouring
    rows; ``prev(c)`` and ``cur(c)`` give their columns, which must be ``time`` or
    listed in ``uses``.  Adds ``seq``, ``n``, ``run_id`` (0, 1, ... per recording),
    ``run_start`` (seq of the run's first row), ``run_start_t`` and ``run_pos``.

    The condition is evaluated inside slices and once more between neighbouring
    slices, where it decides whether the first row of a slice goes on with the
    run left open before it.
    """
    require_columns(df, uses)
    sliced = stream.sliced(df)
    w = stream.in_slice()
    edge_columns = list(dict.fromkeys([stream.time, *stream.ties, *uses]))

    def flagged(frame: DataFrame) -> DataFrame:
        inner = F.coalesce(breaks(lambda c: F.lag(c).over(w), F.col), F.lit(True))
        return frame.select(
            *frame.columns, F.row_number().over(w).alias("_rank"), inner.alias("_differs")
        ).withColumn("_break", F.col("_differs") & (F.col("_rank") > 1))

    mark = F.struct(F.col(stream.time).alias("t"), F.col("_rank").cast("bigint").alias("at"))
    narrow = sliced.select(*dict.fromkeys([*stream.slice_keys, *edge_columns]))
    summary = flagged(narrow).groupBy(*stream.slice_keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col("_break").cast("bigint")).alias("_inner"),
        F.max(F.when(F.col("_break"), mark)).alias("_inner_last"),
        F.min(F.struct(*edge_columns)).alias("_first"),
        F.max(F.struct(*edge_columns)).alias("_last"),
    )
    order = stream.across_slices()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    summary = summary.select(
        "*",
        F.lag("_last").over(order).alias("_before"),
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(*stream.keys)).alias("_length"),
    )
    fresh = F.col("_before").isNull() | F.coalesce(
        breaks(lambda c: F.col("_before")[c], lambda c: F.col("_first")[c]), F.lit(True)
    )
    summary = summary.withColumn("_fresh", fresh)
    opened = F.struct(F.col("_first")[stream.time].alias("t"), F.col("_base").alias("at"))
    summary = summary.withColumn(
        "_open",
        F.when(
            F.col("_inner") > 0,
            F.struct(F.col("_inner_last.t").alias("t"), (F.col("_base") + F.col("_inner_last.at") - 1).alias("at")),
        ).when(F.col("_fresh"), opened),
    )
    carried = summary.select(
        *stream.slice_keys,
        "_base",
        "_length",
        (
            F.coalesce(F.sum(F.col("_inner") + F.col("_fresh").cast("bigint")).over(earlier), zero)
            + F.col("_fresh").cast("bigint")
        ).alias("_runs"),
        F.when(F.col("_fresh"), opened).otherwise(F.last("_open", ignorenulls=True).over(earlier)).alias("_start"),
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = flagged(sliced).select(
        *sliced.columns,
        "_rank",
        F.sum(F.col("_break").cast("bigint")).over(upto).alias("_run_here"),
        F.last(F.when(F.col("_break"), mark), ignorenulls=True).over(upto).alias("_start_here"),
    )
    kept = [c for c in df.columns if c not in ("seq", "n", SLICE, "run_id", "run_start", "run_start_t", "run_pos")]
    seq = F.col("_base") + F.col("_rank") - 1
    start = F.coalesce(F.col("_base") + F.col("_start_here.at") - 1, F.col("_start.at"))
    return local.join(carried, stream.slice_keys).select(
        *kept,
        seq.alias("seq"),
        F.col("_length").alias("n"),
        (F.col("_runs") + F.col("_run_here") - 1).alias("run_id"),
        start.alias("run_start"),
        F.coalesce(F.col("_start_here.t"), F.col("_start.t")).alias("run_start_t"),
        (seq - start).alias("run_pos"),
    )


def with_running(
    df: DataFrame, stream: Stream, running: dict[str, tuple[Callable[[str], Column], str]], backwards: bool = False,
    before: bool = False,
) -> DataFrame:
    """Add running values of a recording: ``{name: (F.min or F.max, column)}`` over the rows up to each one.

    ``backwards`` runs from the last row; ``before`` leaves the row itself out.  Values of other slices arrive through
    the slice summary.
    """
    require_columns(df, [c for _, c in running.values()])
    sliced = stream.sliced(df)
    summary = sliced.groupBy(*stream.slice_keys).agg(*[f(c).alias(f"_in_{name}") for name, (f, c) in running.items()])
    toward = F.desc if backwards else F.asc
    order = Window.partitionBy(*stream.keys).orderBy(toward(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*stream.slice_keys, *[f(f"_in_{name}").over(order).alias(f"_from_{name}") for name, (f, _) in running.items()])
    here = Window.partitionBy(*stream.slice_keys).orderBy(*[toward(c) for c in (stream.time, *stream.ties)])
    here = here.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = sliced.withColumns({f"_here_{name}": f(c).over(here) for name, (f, c) in running.items()}).join(carried, stream.slice_keys)
    # Both aggregates ignore nulls, as greatest and least do.
    both = {F.max: F.greatest, F.min: F.least}
    kept = [c for c in df.columns if c not in (*running, SLICE)]
    return joined.select(*kept, *[both[f](f"_here_{name}", f"_from_{name}").alias(name) for name, (f, _) in running.items()])
