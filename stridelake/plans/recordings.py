"""From raw recordings to labelled windows, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators.columns import drop_incomplete, filter_labels, unpivot_positions
from stridelake.operators.joins import fuse_sensors, join_labels_exact, join_labels_segments, tick_runs
from stridelake.operators.labels import encode_sorted, encode_vocab
from stridelake.operators.ordered import number_rows
from stridelake.operators.resample import block_ids, block_mean, resample_nearest
from stridelake.operators.windows import (
    any_label,
    assemble_windows,
    chunk_runs,
    contiguous_windows,
    sliding_windows,
    tumbling_windows,
)
from stridelake.sources.folders import stored
from stridelake.stream import Stream


def resampled_with_labels(
    df: DataFrame, stream: Stream, channels: Sequence[str], label: str, p: int, q: int, code: str = "label"
) -> DataFrame:
    """Block means with the coded label of each block's first row; blocks carry ``seq`` and ``n``.

    Labels are coded first: numbers keep the block aggregation a hash aggregation.
    Blocks of a recording are counted from its length, so they need no numbering
    of their own.
    """
    coded = encode_sorted(df.select(*dict.fromkeys([*stream.columns, *channels, label])), label, code).drop(label)
    placed = block_ids(number_rows(coded, stream), p, q)
    return placed.groupBy(*stream.keys, F.col("block").alias("seq"), F.col("n_blocks").alias("n")).agg(
        F.expr(f"sum(`{stream.time}`) div count(`{stream.time}`)").alias(stream.time),
        *[F.avg(c).alias(c) for c in channels],
        F.min_by(code, "seq").alias(code),
    )


def labelled_window_features(
    df: DataFrame, stream: Stream, channels: Sequence[str], label: str, p: int, q: int, size: int
) -> DataFrame:
    """Resample, cut into windows, merge labels, and summarise the first two channels."""
    long = tumbling_windows(resampled_with_labels(df, stream, channels, label, p, q), stream, size)
    main, other = channels[:2]
    seen = F.array_sort(F.collect_set("label"))
    windows = long.groupBy(*stream.keys, "window_no").agg(
        F.round(F.avg(main), 6).alias(f"mean_{main}"), F.round(F.min(main), 6).alias(f"min_{main}"),
        F.round(F.max(main), 6).alias(f"max_{main}"), F.round(F.avg(other), 6).alias(f"mean_{other}"),
        F.min(stream.time).alias("start_t"), seen.alias("_seen"),
    )
    return windows.withColumn("label", any_label("_seen")).drop("_seen")


def recording_windows(
    df: DataFrame, stream: Stream, channels: Sequence[str], label: str, p: int, q: int, size: int, strict: bool = False
) -> DataFrame:
    """Windows in array form, ready for a window dataset: ``data`` and the coded label of step 0."""
    long = tumbling_windows(
        resampled_with_labels(df, stream, channels, label, p, q), stream, size, size + 1 if strict else None
    )
    return assemble_windows(long, [*stream.keys, "window_no"], channels, first=["label"])


def nearest_windows(
    df: DataFrame, stream: Stream, channels: Sequence[str], label: str, size: int, hop: int, hz: float | None = None,
    step: int | None = None,
) -> DataFrame:
    """Rows nearest to a grid, cut into sliding windows; the label is that of step 0.

    Windows count the rows that stayed, and a primitive reads its input twice
    (samples and summary), so the resampled rows are stored in between.
    """
    columns = list(dict.fromkeys([*stream.columns, *channels, label]))
    kept = stored(resample_nearest(df.select(*columns), stream, hz, step), "resampled")
    long = sliding_windows(kept, stream, size, hop)
    return assemble_windows(long, [*stream.keys, "window_no"], channels, first=[label])


def fused_windows(
    first: DataFrame, second: DataFrame, stream: Stream, channels: Sequence[str], label: str, width: int, size: int,
    overlap: int = 0, names: tuple[str, str] = ("acc", "gyro"),
) -> DataFrame:
    """Two sensors fused on ticks; windows of consecutive ticks with their label, in long form.

    ``keys, run_id, window_no, step`` and the ticks' columns; windows that a run
    leaves unfinished are out.
    """
    ticks = stored(fuse_sensors(first, second, stream, channels, label, width, names), "ticks")
    runs = tick_runs(ticks, stream, width)
    chunks = chunk_runs(runs, stream, size, overlap)
    window = [*stream.keys, "run_id", "window_no"]
    whole = chunks.groupBy(*window).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") == size).drop("_rows")
    return chunks.join(whole, window, "left_semi")


def gap_free_windows(
    samples: DataFrame, labels: DataFrame, on: Sequence[str], stream: Stream, channels: Sequence[str], label: str,
    wanted: Sequence[int], size: int, hop: int, gap: int,
) -> DataFrame:
    """A long log with labels of equal time: windows without a gap in time or a change of label, with their data.

    Rows with a missing channel are left out first, then rows whose label is not
    ``wanted``; what both leave out makes gaps.  The joined rows are stored, because
    windows read them twice.
    """
    whole = drop_incomplete(samples.select(*dict.fromkeys([*stream.columns, *on, *channels])), channels)
    kept = filter_labels(join_labels_exact(whole, labels, on), label, wanted)
    return contiguous_windows(stored(kept, "labelled"), stream, size, hop, gap, label, channels)


def _block_windows(blocks: DataFrame, keys: Sequence[str], channels: Sequence[str], size: int, min_rows: int | None, first: Sequence[str]) -> DataFrame:
    """Windows of consecutive blocks in array form; a slice holds a hundred thousand blocks at most."""
    long = tumbling_windows(stored(blocks, "blocks"), Stream(tuple(keys), "block", (), 100_000), size, min_rows)
    return assemble_windows(long, [*keys, "window_no"], channels, first=first)


def segment_windows(
    samples: DataFrame, segments: DataFrame, keys: Sequence[str], channels: Sequence[str], activity: str, p: int, q: int,
    size: int, at_most: int | None = None, seq: str = "seq",
) -> DataFrame:
    """Numbered samples and labelled segments of row numbers: each segment resampled by itself, cut into windows.

    ``samples`` carry their row number ``seq``; ``segments`` have ``start_idx`` and
    ``end_idx`` (not included) and an activity, of which those above ``at_most`` are
    left out.  A segment needs more blocks than one window has.  Row numbers within a
    segment are arithmetic, so samples are shuffled to their segments only.
    """
    kept = filter_labels(segments.select(*keys, activity, "start_idx", "end_idx"), activity, at_most=at_most)
    rows = join_labels_segments(samples.select(*keys, seq, *channels), kept, keys, seq)
    placed = rows.withColumn("n", (F.col("end_idx") - F.col("start_idx")).cast("bigint")).withColumn("seq", (F.col(seq) - F.col("start_idx")).cast("bigint"))
    segment = (*keys, "start_idx", activity)
    blocks = block_mean(placed, Stream(segment, "seq"), channels, p, q, tail="drop_last").drop("n_rows")
    return _block_windows(blocks, segment, channels, size, size + 1, [])


def position_windows(
    df: DataFrame, keys: Sequence[str], order: Stream, groups: Sequence[Sequence[str]], channels: Sequence[str], label: str,
    vocabulary: Sequence[str], p: int, q: int, size: int, code: str = "label",
) -> DataFrame:
    """A table with sensor positions side by side: one recording per activity and position, resampled and cut into windows.

    ``order`` gives time and ties of the rows of ``keys``.  Rows whose label is not in
    the vocabulary are left out (``unknown_labels`` counts them).
    """
    used = dict.fromkeys([*keys, order.time, *order.ties, label, *[c for g in groups for c in g]])
    coded = encode_vocab(df.select(*used), label, vocabulary, out=code).filter(F.col(code).isNotNull()).drop(label)
    long = unpivot_positions(coded, groups, channels)
    recording = (*keys, code, "position")
    stream = Stream(recording, order.time, order.ties, order.slice_width)
    blocks = block_mean(long, stream, channels, p, q, guard="le").drop("n_rows")
    return _block_windows(blocks, recording, channels, size, None, [])
