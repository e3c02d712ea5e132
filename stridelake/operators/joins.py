"""Alignment of sensors and label streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.ordered import mark_runs, numbered
from stridelake.operators.resample import _div
from stridelake.stream import SLICE, Stream, require_columns


def join_labels_exact(samples: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on identity and equal time; a repeated label time repeats the sample."""
    require_columns(samples, on)
    require_columns(labels, on)
    return samples.join(labels, list(on), "left")


def join_labels_segments(
    samples: DataFrame, segments: DataFrame, keys: Sequence[str], seq: str = "seq",
    start: str = "start_idx", end: str = "end_idx", bucket: int | None = None,
) -> DataFrame:
    """Rows with ``start <= seq < end`` of the same recording, once per segment that holds them.

    Both sides meet on a bucket of row numbers, so a long recording is spread
    and a row is compared with the segments near it only.  Without ``bucket``, it is
    the mean length of the segments (one small job now): a row then meets about two.
    """
    require_columns(samples, [*keys, seq])
    require_columns(segments, [*keys, start, end])
    if bucket is None:
        length = segments.agg(F.avg((F.col(end) - F.col(start)).cast("double"))).first()[0]
        bucket = min(max(int(length or 0), 64), 65_536)
    spread = segments.filter(F.col(start) < F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(_div(F.col(start).cast("bigint"), bucket), _div(F.col(end).cast("bigint") - 1, bucket)))
    )
    placed = samples.withColumn("_bucket", _div(F.col(seq), bucket))
    inside = (F.col(seq) >= F.col(start)) & (F.col(seq) < F.col(end))
    return placed.join(spread, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def join_nearest(
    samples: DataFrame, labels: DataFrame, stream: Stream, label_time: str, label_ties: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Give every sample the label nearest in time, the later one when two are as near.

    Of labels with one time the first counts; before the first and after the last
    label that label holds; a recording without labels has no result.  Adds
    ``values`` and ``matched_t``.  Samples and labels are merged and shuffled once
    on ``(keys, slice)``; labels of other slices arrive through a summary.
    """
    require_columns(samples, stream.columns)
    require_columns(labels, [*stream.keys, label_time, *label_ties, *values])
    t = stream.time
    tie = [F.col(c).alias(f"_tie_{i}") for i, c in enumerate(label_ties)]
    tie_names = [f"_tie_{i}" for i in range(len(label_ties))]
    merged_labels = labels.select(
        *stream.keys, F.col(label_time).cast("bigint").alias("_t"), F.struct(*tie, *values).alias("_label"),
        F.lit(0).alias("_kind"), F.lit(None).cast(samples.select(F.struct(*samples.columns)).schema[0].dataType).alias("_row"),
    )
    merged_samples = samples.select(
        *stream.keys, F.col(t).alias("_t"),
        F.lit(None).cast(merged_labels.schema["_label"].dataType).alias("_label"), F.lit(1).alias("_kind"),
        F.struct(*samples.columns).alias("_row"),
    )
    by_time = stream.ordered_by("_t").whole_times()
    merged = by_time.sliced(merged_labels.unionByName(merged_samples))

    # Labels of a slice: its last, with the first of that time, and its first.
    def sort_key(sign: int):
        return F.struct((F.col("_t") * sign).alias("k"), *[F.col("_label")[c].alias(c) for c in tie_names])

    stamped = F.struct(F.col("_t").alias("t"), F.col("_label").alias("label"))
    slices = merged.filter("_kind = 1").select(*by_time.slice_keys).distinct().withColumns(
        {"_first": F.lit(None).cast(merged.select(stamped).schema[0].dataType)}
    ).withColumn("_last", F.col("_first"))
    ends = by_time.sliced(merged_labels).groupBy(*by_time.slice_keys).agg(
        F.min_by(stamped, sort_key(1)).alias("_first"), F.min_by(stamped, sort_key(-1)).alias("_last")
    )
    order = by_time.across_slices()
    carried = slices.unionByName(ends).groupBy(*by_time.slice_keys).agg(
        F.max("_first").alias("_first"), F.max("_last").alias("_last")
    ).select(
        *by_time.slice_keys,
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_prev"),
        # Read backwards, so that every row adds to one running value.
        F.last("_first", ignorenulls=True)
        .over(Window.partitionBy(*stream.keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry_next"),
    )
    # Only the first label of a time stays; equal times share a slice.
    ranked = merged.withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy(*by_time.slice_keys).orderBy("_t", "_kind", *[F.col("_label")[c] for c in tie_names])
        ),
    )
    up = Window.partitionBy(*by_time.slice_keys).orderBy("_rank")
    down = Window.partitionBy(*by_time.slice_keys).orderBy(F.desc("_rank"))
    is_label = F.col("_kind") == 0
    again = (F.lag("_kind").over(up) == 0) & (F.lag("_t").over(up) == F.col("_t"))
    cleaned = ranked.withColumn("_again", is_label & F.coalesce(again, F.lit(False))).filter("not _again")
    # A label at the sample's own time sorts before it and is at distance zero.
    local = cleaned.withColumns(
        {
            "_prev": F.last(F.when(is_label, stamped), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)),
            "_next": F.last(F.when(is_label, stamped), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("_kind = 1")
    both = local.join(carried, by_time.slice_keys).select(
        "_row", "_t", F.coalesce("_prev", "_carry_prev").alias("_prev"), F.coalesce("_next", "_carry_next").alias("_next")
    )
    later = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev.t") >= F.col("_next.t") - F.col("_t"))
    exact = F.col("_prev.t") == F.col("_t")
    pick = F.when(exact, F.col("_prev")).when(F.col("_next").isNotNull() & later, F.col("_next")).otherwise(F.col("_prev"))
    return both.withColumn("_pick", pick).filter(F.col("_pick").isNotNull()).select(
        "_row.*", *[F.col("_pick.label")[v].alias(v) for v in values], F.col("_pick.t").alias("matched_t")
    )


def alignment_error(aligned: DataFrame, time: str, matched: str = "matched_t", keys: Sequence[str] = ()) -> DataFrame:
    """Mean and greatest distance to the matched time."""
    distance = F.abs(F.col(time) - F.col(matched))
    return aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(distance).alias("mean_abs_dt"), F.max(distance).alias("max_abs_dt")
    )


def fuse_sensors(
    first: DataFrame, second: DataFrame, stream: Stream, channels: Sequence[str], label: str, width: int,
    names: tuple[str, str] = ("acc", "gyro"),
) -> DataFrame:
    """Two sensors averaged on common ticks of ``width``; ticks both sensors saw.

    Both are merged in time.  A session goes on while rows are less than ``width``
    apart and the label stays; ticks count from the session's first time.  A tick
    needs rows of both sensors.  Returns ``keys, session, anchor_t, tick, tick_t``,
    the label and ``<name>_<channel>`` for both.
    """
    tagged = [
        f.select(*stream.columns, label, *channels).withColumn("_sensor", F.lit(i)) for i, f in enumerate((first, second))
    ]
    merged = tagged[0].unionByName(tagged[1])
    both = stream.ordered_by(stream.time, ("_sensor", *stream.ties))
    t = stream.time
    sessions = mark_runs(
        merged,
        both,
        lambda prev, cur: (cur(t) - prev(t) >= width) | ~cur(label).eqNullSafe(prev(label)),
        uses=[label],
    )
    tick = _div(F.col(t) - F.col("run_start_t"), width)
    cells = sessions.withColumn("tick", tick).groupBy(
        *stream.keys, F.col("run_id").alias("session"), F.col("run_start_t").alias("anchor_t"), "tick", label
    )
    counted = [F.count(F.when(F.col("_sensor") == i, True)).alias(f"_n{i}") for i in (0, 1)]
    means = [
        F.avg(F.when(F.col("_sensor") == i, F.col(c))).alias(f"{name}_{c}")
        for i, name in enumerate(names)
        for c in channels
    ]
    return (
        cells.agg(*counted, *means)
        .filter((F.col("_n0") > 0) & (F.col("_n1") > 0))
        .withColumn("tick_t", F.col("anchor_t") + F.col("tick") * F.lit(width))
        .drop("_n0", "_n1")
    )


def tick_runs(ticks: DataFrame, stream: Stream, width: int) -> DataFrame:
    """Runs of ticks that follow one another in a session; see ``chunk_runs``.

    A session ends ``width`` after its last row, so two sessions may meet at one
    tick distance: the session is compared as well.
    """
    return mark_runs(
        ticks,
        stream.ordered_by("tick_t", ("session",)),
        lambda prev, cur: (cur("tick_t") - prev("tick_t") != width) | (cur("session") != prev("session")),
    )


def zip_chunks(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sensors at the same chunk and step; the shorter recording ends both."""
    return first.join(second, list(on))


def zip_rows(first: DataFrame, second: DataFrame, streams: tuple[Stream, Stream]) -> DataFrame:
    """Columns of two tables of one recording side by side, by row number."""
    keys = list(streams[0].keys)
    left = numbered(first, streams[0])
    right = numbered(second, streams[1]).drop("n")
    return left.join(right, [*keys, "seq"])


def length_mismatches(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recordings whose two tables differ in length; empty when :func:`zip_rows` is whole."""
    counts = [
        f.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for f, name in ((first, "rows_first"), (second, "rows_second"))
    ]
    zero = F.lit(0).cast("bigint")
    return counts[0].join(counts[1], list(keys), "full").select(
        *keys, F.coalesce("rows_first", zero).alias("rows_first"), F.coalesce("rows_second", zero).alias("rows_second")
    ).filter("rows_first <> rows_second")


def decode_labels(df: DataFrame, names: Sequence[str], column: str, out: str = "name") -> DataFrame:
    """Class ids to names; an id outside the list is written as text."""
    known = F.get(F.array(*[F.lit(n) for n in names]), F.col(column).cast("int"))
    return df.withColumn(out, F.coalesce(known, F.col(column).cast("string")))


def join_embeddings(embeddings: DataFrame, labels: DataFrame, key: str = "window_id") -> DataFrame:
    return embeddings.join(labels, key)
