"""Live recordings on Structured Streaming: ingest, resample, sessions, windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.sources.samples import DUAL_LOG_COLUMNS, doubles
from stridelake.stream import require_columns


def parse_lines(lines: DataFrame, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Keep lines that begin with a digit or a minus sign and read their fields.

    A field that is missing or is no value of its type becomes null.
    """
    fields = doubles(DUAL_LOG_COLUMNS) if schema is None else schema
    ddl = fields if isinstance(fields, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    blanks = "[\\r\\n]" if sep == "\t" else "[\\r\\n\\t]"  # a tab may be the separator
    text = F.trim(F.regexp_replace("value", blanks, " "))
    return lines.select(text.alias("_line")).filter(F.col("_line").rlike("^[0-9-]")).select(
        F.from_csv("_line", ddl, {"sep": sep, "mode": "PERMISSIVE"}).alias("_row")
    ).select("_row.*")


def stream_samples(
    spark: SparkSession, folder: str, schema: str | T.StructType | None = None, sep: str = ",",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder that a logger writes text files to, as a stream of samples."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.load(folder), schema, sep)


def stream_resample(
    df: DataFrame, keys: Sequence[str], time: str, channels: Sequence[str], bucket: str, delay: str
) -> DataFrame:
    """Mean per channel in buckets of event time; rows later than ``delay`` are dropped.

    Works on batch frames as well.  ``time`` is a timestamp with time zone.
    """
    require_columns(df, [*keys, time, *channels])
    if not isinstance(df.schema[time].dataType, T.TimestampType):
        raise ValueError(f"{time} must be a timestamp with time zone; cast it first")
    buckets = df.withWatermark(time, delay).groupBy(*keys, F.window(time, bucket).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in channels]
    )
    return buckets.select(*keys, F.col("_w.start").alias("bucket_start"), "n_rows", *channels)


def stream_sessions(df: DataFrame, keys: Sequence[str], time: str, gap_us: int, delay: str) -> DataFrame:
    """Runs of rows less than ``gap_us`` microseconds apart: count, first and last time.

    Session windows join at equal bounds, so theirs is one microsecond shorter.
    """
    require_columns(df, [*keys, time])
    window = F.session_window(time, f"{gap_us - 1} microseconds")
    sessions = df.withWatermark(time, delay).groupBy(*keys, window.alias("_w")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
    return sessions.select(*keys, "n_rows", "first_time", "last_time")


def stream_windows(
    df: DataFrame, key: str, order: str, channels: Sequence[str], size: int, hop: int, out: str = "data",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Every full window of ``size`` rows per recording, as soon as its last row is there.

    Rows count in the order in which triggers bring them; those of one trigger are
    sorted by ``order``, equal ones by ``ties``.  A row behind the last one taken is
    late (one of equal ``order`` is not): it is left out and counted in ``late_rows``
    of the next window that its trigger makes for the recording.  Where it makes none,
    a row comes out at once that is null but for the recording and ``late_rows``;
    filter on ``window_no`` to have windows only.  The state of a recording holds
    fewer than ``size`` rows.

    Counting arrivals ties a recording to one task, which holds what a trigger
    brings of it (``maxFilesPerTrigger`` bounds that).  Where rows carry a number,
    :func:`stream_windows_numbered` spreads a recording over tasks.
    """
    if size <= 0 or hop <= 0:
        raise ValueError("size and hop must be positive")
    require_columns(df, [key, order, *ties, *channels])
    width = len(channels)
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("window_no", T.LongType()),
            T.StructField("first_order", T.LongType()),
            T.StructField("late_rows", T.LongType()),
            T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    state_schema = "last_order bigint, skip bigint, next_window bigint, late bigint, orders array<bigint>, cells array<double>"

    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, skip, window_no, late, orders, cells = state.get
            orders, cells = list(orders), list(cells)
        else:
            last, skip, window_no, late, orders, cells = None, 0, 0, 0, [], []
        fresh = pd.concat(list(frames)).sort_values([order, *ties], kind="stable")
        if last is not None:
            in_time = fresh[order] >= last
            late += int((~in_time).sum())
            fresh = fresh[in_time]
        if len(fresh):
            last = int(fresh[order].iloc[-1])
        at = np.concatenate([np.array(orders, dtype="int64"), fresh[order].to_numpy("int64")])
        values = np.concatenate(
            [np.array(cells, dtype="float64").reshape(-1, width), fresh[list(channels)].to_numpy("float64")]
        )
        # With hop > size, rows between two windows are skipped, perhaps over several triggers.
        start = min(skip, len(at))
        skip -= start
        made = []
        while skip == 0 and start + size <= len(at):
            made.append((keys[0], window_no, int(at[start]), late, values[start : start + size].tolist()))
            window_no, late, start = window_no + 1, 0, start + hop
            if start > len(at):
                skip, start = start - len(at), len(at)
        if late:  # a recording may end here, so the count does not wait for a window
            made.append((keys[0], None, None, late, None))
            late = 0
        state.update((last, skip, window_no, late, at[start:].tolist(), values[start:].ravel().tolist()))
        frame = pd.DataFrame(made, columns=schema.names)
        yield frame.astype({"window_no": "Int64", "first_order": "Int64"})

    extra = [c for c in dict.fromkeys(ties) if c not in (key, order, *channels)]
    return df.select(key, F.col(order).cast("bigint").alias(order), *extra, *channels).groupBy(key).applyInPandasWithState(
        advance, schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


#: Rows of the windows of a recording that stay together.
BLOCK_ROWS = 16_384
#: States that blocks of windows are dealt to; a call and a state cost more than the rows of a short recording.
GROUPS = 4_096
#: Windows that come out of a state at a time.
WINDOWS_AT_ONCE = 4_096


def stream_windows_numbered(
    df: DataFrame, key: str, seq: str, channels: Sequence[str], size: int, hop: int, out: str = "data",
    time: str | None = None, delay: str = "0 seconds", forget_after_ms: int = 0,
) -> DataFrame:
    """Full windows of recordings whose rows are numbered 0, 1, ... by their source.

    The number says which windows a row belongs to, so a recording is cut into blocks of
    neighbouring windows, ``BLOCK_ROWS`` rows of them or one, and those are dealt to ``GROUPS``
    states by hash: a long recording is spread, short ones share a state, and a task holds one
    state's rows of a trigger.  Rows may come in any order; of rows with one number the first to
    come counts.  A state holds the rows of unfinished windows.  A window that loses a row never fills; with an event ``time`` and its watermark ``delay``, its rows go once the
    watermark is ``forget_after_ms`` past its last row.
    """
    if size <= 0 or hop <= 0:
        raise ValueError("size and hop must be positive")
    require_columns(df, [key, seq, *channels, *([time] if time else [])])
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("window_no", T.LongType()),
            T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    width = len(channels)
    per_block = max(1, BLOCK_ROWS // size)
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout

    def collect(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Windows by recording and number.  A place counts the rows of the windows one after the other: window * size + step.
        index, places, cells = {}, np.zeros(0, "int64"), np.zeros((0, width))
        last_ms, until = np.zeros(0, "int64"), np.zeros(0, "int64")  # a window's last row's time, and up to which watermark it stays
        if state.exists:
            owners, numbers, counts, steps, values, last_ms, until = state.get
            index = {pair: i for i, pair in enumerate(zip(owners, numbers))}
            places = np.repeat(np.arange(len(index)), counts) * size + np.array(steps, "int64")
            cells = np.array(values, "float64").reshape(-1, width)
            last_ms, until = np.array(last_ms, "int64"), np.array(until, "int64")
        touched = np.zeros(len(index), bool)
        for frame in () if state.hasTimedOut else frames:
            number, base = frame["_seq"].to_numpy("int64"), frame["_block"].to_numpy("int64") * per_block
            first = np.maximum(-((size - 1 - number) // hop), base)
            count = np.minimum(number // hop, base + per_block - 1) - first + 1
            at = np.repeat(np.arange(len(number)), count)
            window = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            owner_at, owners = pd.factorize(frame[key], use_na_sentinel=False)
            window_at, windows = pd.factorize(window)
            owners, windows = [None] if keys[0] < 0 else owners.tolist(), windows.tolist()
            pairs, pair_at = np.unique(owner_at[at] * len(windows) + window_at, return_inverse=True)
            found = [(owners[p // len(windows)], windows[p % len(windows)]) for p in pairs.tolist()]
            slot = np.array([index.setdefault(pair, len(index)) for pair in found], "int64")[pair_at]
            added = len(index) - len(touched)
            last_ms, until, touched = (np.pad(x, (0, added)) for x in (last_ms, until, touched))
            touched[slot] = True
            if time:
                np.maximum.at(last_ms, slot, frame["_ms"].to_numpy("int64")[at])
            both = np.concatenate([places, slot * size + number[at] - window * hop])
            places, kept = np.unique(both, return_index=True)  # the first row of a number counts
            cells = np.concatenate([cells, frame[list(channels)].to_numpy("float64")[at]])[kept]
        of_window = places // size
        counts = np.bincount(of_window, minlength=len(index))
        full, gone = counts == size, np.zeros(len(index), bool)
        if time:
            watermark = state.getCurrentWatermarkMs()
            until[touched] = np.maximum(last_ms[touched] + forget_after_ms, watermark) + 1
            gone = ~touched & (until < watermark)
        named, opened = list(index), np.flatnonzero(~(full | gone))
        if len(opened):
            rest = ~(full | gone)[of_window]
            owners, numbers = zip(*[named[i] for i in opened.tolist()])
            steps, values = (places[rest] % size).tolist(), cells[rest].ravel().tolist()
            state.update((list(owners), list(numbers), counts[opened].tolist(), steps, values, last_ms[opened].tolist(), until[opened].tolist()))
            if time:
                state.setTimeoutTimestamp(int(until[opened].min()))
        elif state.exists:
            state.remove()
        done, rows = np.flatnonzero(full), cells[full[of_window]].reshape(-1, size, width)
        for i in range(0, len(done), WINDOWS_AT_ONCE):
            made = zip(done[i : i + WINDOWS_AT_ONCE].tolist(), rows[i : i + WINDOWS_AT_ONCE].tolist())
            yield pd.DataFrame([(*named[w], data) for w, data in made], columns=schema.names)

    number = F.col(seq).cast("bigint")
    last = F.floor(number / hop)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((number - (size - 1)) / hop))
    at_ms = [F.coalesce(F.unix_millis(time), F.lit(0).cast("bigint")).alias("_ms")] if time else []
    timed = df.withWatermark(time, delay) if time else df
    placed = timed.select(
        key, number.alias("_seq"), first.alias("_first"), last.alias("_last"), *at_ms, *channels,
        *([F.col(time)] if time and time not in channels else []),
    ).filter("_first <= _last")
    blocks = F.sequence(F.floor(F.col("_first") / per_block), F.floor(F.col("_last") / per_block))
    blocked = placed.withColumn("_block", F.explode(blocks)).drop("_first", "_last")
    # Rows without a recording stay apart, below zero: a column of numbers and nulls would lose digits in a task.
    dealt = F.pmod(F.xxhash64(key, "_block"), F.lit(GROUPS))
    state_schema = (
        f"owners array<{df.schema[key].dataType.simpleString()}>, windows array<bigint>, counts array<bigint>, steps array<bigint>, "
        "cells array<double>, last_ms array<bigint>, until array<bigint>"
    )
    return blocked.withColumn("_group", F.when(F.col(key).isNull(), -1 - dealt).otherwise(dealt)).groupBy(
        "_group"
    ).applyInPandasWithState(collect, schema, state_schema, "append", timeout)


def end_of_feed(rows: DataFrame, time: str, after: str) -> DataFrame:
    """One row, null but for a time that lies ``after`` the last one.

    Appended to a feed that has ended, it moves the watermark past all open buckets
    and sessions, so that they come out; it stays open itself.
    """
    last = rows.agg((F.max(time) + F.expr(f"interval {after}")).alias(time))
    return last.select(*[F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take everything that is there, write it to Parquet and stop; both folders are shared ones."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
