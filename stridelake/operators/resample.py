"""Rate changes: block means, nearest-grid selection, time repair, rate inference.

A ratio of source to target rate is a rational ``p/q``.  Row ``i`` of a
recording belongs to block ``((i + 1) * q - 1) div p`` and block ``k`` starts at
row ``(k * p) div q``, so blocks follow from the row number alone and the mean is
an ordinary aggregation with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.ordered import number_rows, numbered, slice_edges, with_neighbours
from stridelake.stream import SLICE, Stream, require_columns


def _div(a: Column, b: Column | int) -> Column:
    """Exact quotient of non-negative integers."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def _mean(column: str, stream_time: str) -> Column:
    if column == stream_time:  # integer microseconds would lose digits as doubles
        return F.expr(f"sum(`{column}`) div count(`{column}`)").alias(column)
    return F.avg(column).alias(column)


def _block_rows(rows: DataFrame, p: Column, q: Column, tail: str, guard: str) -> DataFrame:
    """Add ``block`` and drop the rows of blocks that the tail rule leaves out."""
    n = F.col("n")
    block = _div((F.col("seq") + 1) * q - 1, p)
    ends = _div(block * p, q) + _div(p, q) + 1
    in_fraction = (ends < n) if guard == "lt" else (ends <= n)
    in_whole = F.lit(True) if tail == "keep" else (block + 1) * _div(p, q) < n
    return rows.withColumn("block", block).filter(F.when(F.pmod(p, q) == 0, in_whole).otherwise(in_fraction))


def _mean_blocks(
    rows: DataFrame, keys: Sequence[str], time: str, channels: Sequence[str], p: Column, q: Column,
    tail: str, guard: str,
) -> DataFrame:
    return _block_rows(rows, p, q, tail, guard).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n_rows"), *[_mean(c, time) for c in channels]
    )


def block_ids(rows: DataFrame, p: int, q: int = 1) -> DataFrame:
    """Rows with ``seq`` and ``n`` to ``block``, with ``n_blocks``, the blocks of the recording.

    Of a fractional ratio, block ``k`` counts when ``(k * p) div q < n - p div q - 1``.
    """
    big_p, big_q = (F.lit(v).cast("bigint") for v in (p, q))
    n = F.col("n")
    if p % q == 0:
        blocks = _div(n - 1, p // q) + 1
    else:
        room = n - p // q - 1  # starts lie below this
        blocks = F.when(room > 0, _div(room * big_q - 1, p) + 1).otherwise(F.lit(0).cast("bigint"))
    return _block_rows(rows, big_p, big_q, "keep", "lt").withColumn("n_blocks", blocks)


def block_mean(
    df: DataFrame, stream: Stream, channels: Sequence[str], p: int, q: int = 1,
    tail: str = "keep", guard: str = "lt",
) -> DataFrame:
    """Mean of blocks of ``p/q`` rows: ``keys, block, n_rows, channels``.

    Whole ratios keep the partial last block, or with ``tail="drop_last"`` (rows
    of a segment) drop it together with a last block that fits exactly.
    Fractional ratios emit block ``k`` while ``start + p div q + 1 < n``; with
    ``guard="le"`` while ``<= n``.
    """
    if p < q or q < 1:
        raise ValueError("the ratio p/q must be at least 1")
    if tail not in ("keep", "drop_last") or guard not in ("lt", "le"):
        raise ValueError("tail is keep or drop_last, guard is lt or le")
    require_columns(df, channels)
    rows = numbered(df.select(*dict.fromkeys([*stream.columns, *channels, *_numbers(df)])), stream)
    big = [F.lit(v).cast("bigint") for v in (p, q)]
    return _mean_blocks(rows, stream.keys, stream.time, channels, *big, tail, guard)


def _numbers(df: DataFrame) -> list[str]:
    return ["seq", "n"] if {"seq", "n"} <= set(df.columns) else []


def keep_increasing(df: DataFrame, stream: Stream, t: str) -> DataFrame:
    """Keep a row if ``t`` is above that of the row just before it, kept or not.

    ``stream.time`` is the order of the file, ``t`` the time it claims.
    """
    rows = with_neighbours(df, stream, [t])
    return rows.filter((F.col("seq") == 0) | (F.col(t) > F.col(f"prev_{t}"))).select(
        *[c for c in df.columns if c not in ("seq", "n")]
    )


def dedup_times(df: DataFrame, stream: Stream) -> DataFrame:
    """The first row, in order, of every time of a recording.

    Equal times share a slice here, so nothing outside the slice is needed.
    """
    stream = stream.whole_times()
    first = F.row_number().over(Window.partitionBy(*stream.slice_keys, stream.time).orderBy(*stream.ties))
    if not stream.ties:
        raise ValueError("give ties: equal times need an order")
    return stream.sliced(df).withColumn("_rank", first).filter("_rank = 1").drop("_rank", SLICE)


def resample_nearest(df: DataFrame, stream: Stream, hz: float | None = None, step: int | None = None) -> DataFrame:
    """The original rows nearest to a regular grid, each at most once.

    The grid starts at the recording's first time and ends half a step after its
    last; a point between two rows takes the later one when it is half way.  A
    row owns the times from the midpoint before it to the midpoint after it, and
    stays if a grid point lies there, so no join with a grid is made.
    """
    if (hz is None) == (step is None):
        raise ValueError("give hz or step")
    dt = F.lit(step if step is not None else round(1_000_000 / hz)).cast("bigint")
    stream = stream.whole_times()  # a row of the grid is the first of its time
    sliced = stream.sliced(df)
    w = stream.in_slice()
    edges = slice_edges(sliced, stream).select(
        *stream.slice_keys, "_t_first", "_t_last",
        F.col("_before")[stream.time].alias("_t_before"), F.col("_after")[stream.time].alias("_t_after"),
    )
    t = F.col(stream.time)
    first_of_time = sliced.withColumn("_lag", F.lag(stream.time).over(w)).filter(
        F.col("_lag").isNull() | (t > F.col("_lag"))
    )
    local = first_of_time.withColumns(
        {"_lag": F.lag(stream.time).over(w), "_lead": F.lead(stream.time).over(w)}
    ).join(edges, stream.slice_keys)
    t0, t_end = F.col("_t_first"), F.col("_t_last")
    before = F.coalesce("_lag", "_t_before")
    after = F.coalesce("_lead", "_t_after")

    def ceil_div(a: Column, b: Column) -> Column:
        return ((a + F.pmod(-a, b)) / b).cast("bigint")

    # Twice the times: midpoints stay whole numbers.
    points = ceil_div((t_end - t0) * 2 + dt, dt * 2)
    low = F.when(before.isNull(), F.lit(0).cast("bigint")).otherwise(ceil_div(before + t - t0 * 2, dt * 2))
    high = F.when(after.isNull(), points).otherwise(ceil_div(t + after - t0 * 2, dt * 2))
    return (
        local.filter(t0 < t_end)
        .filter(F.greatest(low, F.lit(0).cast("bigint")) < F.least(high, points))
        .select(*[c for c in df.columns if c not in ("seq", "n", SLICE)])
    )


def _slice_steps(df: DataFrame, stream: Stream) -> DataFrame:
    """How often each time step occurs in a slice; steps that are not positive, and the first row's, count as null.

    One row per slice and step, with the times between which those rows lie.
    """
    placed = F.lit(True)
    for c in (*stream.keys, stream.time):
        placed &= F.col(c).isNotNull()
    rows = stream.sliced(df.select(*stream.columns).filter(placed))
    step = F.col(stream.time) - F.lag(stream.time).over(stream.in_slice())
    return rows.select(*stream.slice_keys, stream.time, F.when(step > 0, step).alias("_dt")).groupBy(
        *stream.slice_keys, "_dt"
    ).agg(F.count(F.lit(1)).alias("_times"), F.min(stream.time).alias("_first"), F.max(stream.time).alias("_last"))


def _slice_places(steps: DataFrame, stream: Stream) -> DataFrame:
    """One row per slice: rows before it, length of the recording, and the step that leads into it (null if not positive)."""
    slices = steps.groupBy(*stream.slice_keys).agg(
        F.sum("_times").alias("_rows"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    order = stream.across_slices()
    step = F.col("_first") - F.lag("_last").over(order)
    return slices.select(
        *stream.slice_keys,
        F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(*stream.keys)).alias("_length"),
        F.when(step > 0, step).alias("_into"),
    )


def _step_counts(steps: DataFrame, places: DataFrame, stream: Stream) -> DataFrame:
    """``keys, dt, times`` of whole recordings; every recording has a row, of step 0 and no times if it has no step."""
    inside = steps.filter("_dt is not null").select(*stream.keys, F.col("_dt").alias("dt"), F.col("_times").alias("times"))
    into = places.select(
        *stream.keys, F.coalesce("_into", F.lit(0).cast("bigint")).alias("dt"), F.col("_into").isNotNull().cast("bigint").alias("times")
    )
    return inside.unionByName(into).groupBy(*stream.keys, "dt").agg(F.sum("times").alias("times"))


def interval_counts(df: DataFrame, stream: Stream) -> DataFrame:
    """How often each positive time step occurs in a recording."""
    steps = _slice_steps(df, stream)
    return _step_counts(steps, _slice_places(steps, stream), stream).filter("dt > 0")


def infer_rate(df: DataFrame, stream: Stream, units_per_second: int = 1_000_000, bucket: int = 4096) -> DataFrame:
    """``keys, median_dt, rate_hz``: one over the exact median of the positive steps, else 0.

    Equal steps are counted first; a bucket then holds at most ``bucket``
    different steps, so the ranks need no sort of a whole recording.  The samples are
    read and shuffled once; rows without identity or time count for nothing.
    """
    steps = _slice_steps(df, stream)
    return _rates(_step_counts(steps, _slice_places(steps, stream), stream), stream, units_per_second, bucket)


def _rates(counts: DataFrame, stream: Stream, units_per_second: int, bucket: int) -> DataFrame:
    """:func:`infer_rate` from the counts of steps."""
    ordered = Stream(stream.keys, "dt", (), bucket)
    # Both uses ask for the same rows, so that they share one exchange.
    counts = ordered.sliced(counts).filter(F.col(SLICE).isNotNull())
    per_bucket = counts.groupBy(*ordered.slice_keys).agg(F.sum("times").alias("_times"))
    earlier = ordered.across_slices().rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select(
        *ordered.slice_keys,
        F.coalesce(F.sum("_times").over(earlier), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_times").over(Window.partitionBy(*stream.keys)).alias("_total"),
    )
    upto = ordered.in_slice().rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("times").over(upto)).join(base, ordered.slice_keys)
    high = F.col("_base") + F.col("_upto")

    def covers(rank: Column) -> Column:
        return (high - F.col("times") <= rank) & (rank < high)

    # A rank that both middles share is one row, two different rows are averaged; step 0 covers no rank.
    middle = covers(_div(F.col("_total") - 1, 2)) | covers(_div(F.col("_total"), 2))
    median = ranked.groupBy(*stream.keys).agg(F.avg(F.when((F.col("times") > 0) & middle, F.col("dt"))).alias("median_dt"))
    rate = F.when(F.col("median_dt") > 0, F.lit(float(units_per_second)) / F.col("median_dt")).otherwise(F.lit(0.0))
    return median.select(*stream.keys, "median_dt", rate.alias("rate_hz"))


def downsample_if_needed(
    df: DataFrame, stream: Stream, channels: Sequence[str], hz_target: float = 20.0,
    hz_source: float | None = None, units_per_second: int = 1_000_000,
) -> DataFrame:
    """Block means for recordings faster than the target, all others as they are.

    ``keys, block, n_rows, time, channels``; the ratio is taken to a thousandth,
    per recording when the rate is inferred.  Rates and row numbers then come from one
    summary of the slices, so the samples are read twice: for it, and for their means.
    """
    columns = [stream.time, *[c for c in channels if c != stream.time]]
    rows = df.select(*dict.fromkeys([*stream.columns, *columns]))
    if hz_source is None:
        steps = _slice_steps(df, stream)
        places = _slice_places(steps, stream)
        rates = _rates(_step_counts(steps, places, stream), stream, units_per_second, 4096)
        ratio = rates.select(
            *stream.keys, F.round(F.col("rate_hz") / hz_target * 1000).cast("bigint").alias("_p"),
            (F.col("rate_hz") > hz_target).alias("_faster"),
        )
        rows = number_rows(rows, stream, attach=ratio, edges=places.drop("_into"))
    else:
        rows = number_rows(rows, stream).withColumns(
            {"_p": F.lit(round(hz_source / hz_target * 1000)).cast("bigint"), "_faster": F.lit(hz_source > hz_target)}
        )
    q = F.lit(1000).cast("bigint")
    p = F.when(F.col("_faster"), F.greatest(F.col("_p"), q)).otherwise(q)
    return _mean_blocks(rows, stream.keys, stream.time, columns, p, q, "keep", "lt")


def resample_report(before: DataFrame, after: DataFrame, stream: Stream, units_per_second: int = 1_000_000) -> DataFrame:
    """Rows in and out, duration in seconds and achieved rate per recording."""
    rows_in = before.groupBy(*stream.keys).agg(F.count(F.lit(1)).alias("rows_in"))
    out = after.groupBy(*stream.keys).agg(
        F.count(F.lit(1)).alias("rows_out"),
        ((F.max(stream.time) - F.min(stream.time)) / F.lit(float(units_per_second))).alias("duration_s"),
    )
    return rows_in.join(out, list(stream.keys), "left").select(
        *stream.keys,
        "rows_in",
        F.coalesce("rows_out", F.lit(0).cast("bigint")).alias("rows_out"),
        F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        F.when(F.col("duration_s") > 0, (F.col("rows_out") - 1) / F.col("duration_s"))
        .otherwise(F.lit(0.0))
        .alias("rate_hz"),
    )


__all__ = [
    "block_mean", "dedup_times", "downsample_if_needed", "infer_rate", "interval_counts", "keep_increasing",
    "number_rows", "resample_nearest", "resample_report",
]
