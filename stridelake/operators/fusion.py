"""Two sensors on common ticks, scanned one tick after the other.

The scan moves a tick ``tag`` along both sensors.  A sensor gives the rows that follow its last one while they are less
than ``width`` from the tag, before or after it.  The tick is good if both give rows, of one label each and the same; the
next tag is then ``width`` later.  Otherwise the tick is void, its rows are spent, and the next tag is the time of the
next row of either sensor.  The scan ends with the sensor that ends first.

Where a tag falls depends on all ticks before it, so the scan is carried over slices of a recording as a state: the next
tag, and the rows already taken from what follows the slice.  A pause of ``PAUSE`` widths puts any scan on the first row
after it, so recordings are cut there first and the parts are independent.  Slices of one part are scanned at once from
an assumed state, that of a part without void ticks; blocks of slices that did not enter with the state in which the
slice before was left are scanned again, and blocks double, so there are no more rounds than doublings.  A task holds
the slices of a batch of rows, or one slice and the rows just after it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate, islice
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.ordered import mark_runs, with_running
from stridelake.sources.folders import Stored
from stridelake.stream import SLICE, Stream, require_columns

#: Widths without any row after which the scan starts from the next row, wherever its tag was; no tick reaches further.
PAUSE = 3
#: Rows of a slice in file order.
ROWS_PER_SLICE = 1_000_000


def fuse_sequential(
    first: DataFrame, second: DataFrame, stream: Stream, channels: Sequence[str], label: str, width: int,
    names: tuple[str, str] = ("acc", "gyro"), row: str | None = None,
) -> DataFrame:
    """Good ticks of the scan: ``keys, tick_t, label, fresh, first_row`` and ``<name>_<channel>`` for both sensors.

    Rows follow one another by the stream's order, or by the number ``row`` that each sensor's file gives them: then times
    may go back, and a tick can hold rows from before its tag.  ``fresh`` marks a tick whose tag is a row's own time, after
    a void one or a pause; ``first_row`` is the number of the tick's first row of the first sensor (its time, without
    ``row``) and orders the ticks.  A null label agrees with none; the mean over a null value is null.  Rows without
    identity, time or number are left out.  Runs jobs now; the result reads a stored table.
    """
    if width < 1:
        raise ValueError("width must be positive")
    t = stream.time
    order = [row] if row else [t, *stream.ties]
    wanted = list(dict.fromkeys([*stream.columns, *order, label, *channels]))
    for df in (first, second):
        require_columns(df, wanted)
    sensors = [df.select(*wanted).withColumn("_sensor", F.lit(i)) for i, df in enumerate((first, second))]
    merged = sensors[0].unionByName(sensors[1]).dropna(subset=[*stream.keys, t, *([row] if row else [])])
    parts = _parts_by_row(merged, stream, row, width) if row else _parts_by_time(merged, stream, width)
    keys = [*stream.keys, "_part"]
    rows = Stored(stream.ordered_by("_place").sliced(parts), "fusion-rows")
    slices = Stored(_slices(rows.df, stream.keys, width), "fusion-slices")
    placed = _placed(rows.df, slices.df, keys, width)
    states = _settled(placed, slices.df, keys, order, t, label, width)
    headers = slices.df.join(states.df.select(*keys, "_k", "_in"), [*keys, "_k"]).withColumn("_lead", F.lit(True))
    ticks = _scanned(placed, headers, keys, order, t, label, width, size=1, channels=channels, names=names, row=row)
    result = Stored(ticks.drop("_part"), "fusion-ticks")
    for table in (rows, slices, states):
        table.release()
    return result.df


def fused_runs(ticks: DataFrame, stream: Stream) -> DataFrame:
    """Runs of ticks without a void one between them; see ``chunk_runs``."""
    return mark_runs(ticks, stream.ordered_by("first_row"), lambda prev, cur: cur("fresh"), uses=["fresh"])


def _parts_by_time(merged: DataFrame, stream: Stream, width: int) -> DataFrame:
    """``_part``: time of the first row after the last pause; ``_place``: the row's time."""
    t = stream.time
    both = stream.ordered_by(t, ("_sensor", *stream.ties))
    runs = mark_runs(merged, both, lambda prev, cur: cur(t) - prev(t) >= PAUSE * width)
    return runs.select(*merged.columns, F.col("run_start_t").alias("_part"), F.col(t).alias("_place"))


def _parts_by_row(merged: DataFrame, stream: Stream, row: str, width: int) -> DataFrame:
    """The same for rows in file order.

    Times that go back tie rows together: up to a row, its sensor has reached ``_top``, and from it on it goes no lower
    than ``_low``.  A recording can be cut at a time that no row has between the two; ``_place`` is the last such time.
    """
    t = stream.time
    by_row = Stream((*stream.keys, "_sensor"), row, (), ROWS_PER_SLICE)
    reached = with_running(merged, by_row, {"_top": (F.max, t)})
    bounded = Stored(with_running(reached, by_row, {"_low": (F.min, t)}, backwards=True), "fusion-order")
    by_low = stream.ordered_by("_low", ("_sensor", row))
    behind = Stored(with_running(bounded.df, by_low, {"_behind": (F.max, "_top")}, before=True), "fusion-bounds")
    behind_ = F.col("_behind")
    cut = behind.df.withColumns({
        "_cut": F.when(behind_.isNull() | (behind_ < F.col("_low")), F.col("_low")),
        "_pause": F.when(behind_.isNull() | (behind_ + PAUSE * width <= F.col("_low")), F.col("_low")),
    })
    placed = with_running(cut, by_low, {"_place": (F.max, "_cut"), "_part": (F.max, "_pause")})
    return placed.select(*merged.columns, "_part", "_place")


def _slices(rows: DataFrame, identity: Sequence[str], width: int) -> DataFrame:
    """A row per slice: its number ``_k`` in the part, first place, rows of both sensors here and later, and the slices
    that begin less than ``PAUSE`` widths before."""
    keys = [*identity, "_part"]
    counts = [F.count(F.when(F.col("_sensor") == i, True)).alias(f"_own{i}") for i in (0, 1)]
    slices = rows.groupBy(*keys, SLICE).agg(F.min("_place").alias("_begin"), *counts)
    # Read backwards, so that every row adds to one running value.
    later = Window.partitionBy(*identity).orderBy(F.desc("_part"), F.desc("_begin")).rowsBetween(Window.unboundedPreceding, -1)
    rest = [F.coalesce(F.sum(f"_own{i}").over(later), F.lit(0).cast("bigint")).alias(f"_rest{i}") for i in (0, 1)]
    in_part = Window.partitionBy(*keys).orderBy("_begin")
    numbered = slices.select("*", *rest, (F.row_number().over(in_part) - 1).cast("bigint").alias("_k"))
    near = F.collect_list(F.struct("_k", "_begin")).over(in_part.rangeBetween(1 - PAUSE * width, 0))
    return numbered.withColumn("_near", near)


def _placed(rows: DataFrame, slices: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Each row in its slice, and in those before it whose last ticks may reach it."""
    before = F.filter("_near", lambda s: (s["_k"] > 0) & (s["_begin"] + PAUSE * width > F.col("_place")))
    targets = F.concat(F.array("_k"), F.transform(before, lambda s: s["_k"] - 1))
    joined = rows.join(slices.select(*keys, SLICE, "_k", "_near"), [*keys, SLICE])
    return joined.withColumn("_k", F.explode(targets)).drop(SLICE, "_near", "_place")


STATE = "struct<tag: bigint, skip0: bigint, skip1: bigint>"


def _settled(placed, slices, keys, order, t, label, width) -> Stored:
    """``keys, _k, _in, _out``: the state in which the scan enters and leaves each slice."""
    start = F.when(F.col("_k") == 0, F.struct(F.lit(None).cast("bigint").alias("tag"), F.lit(0).cast("bigint").alias("skip0"), F.lit(0).cast("bigint").alias("skip1")))
    ticks = F.ceil((F.col("_begin") - F.col("_part")) / F.lit(width)).cast("bigint")
    assumed = F.struct((F.col("_part") + ticks * width).alias("tag"), F.lit(None).cast("bigint").alias("skip0"), F.lit(None).cast("bigint").alias("skip1"))
    headers = slices.withColumns({"_in": F.coalesce(start, assumed).cast(STATE), "_lead": F.lit(True)})
    states = Stored(_scanned(placed, headers, keys, order, t, label, width, size=1), "fusion-states")
    size = 1
    while True:
        left = F.lag("_out").over(Window.partitionBy(*keys).orderBy("_k"))
        checked = states.df.withColumn("_left", left)
        size *= 2
        blocks = checked.withColumn("_block", F.floor(F.col("_k") / size))
        wrong = blocks.filter("_k > 0 and not (_in <=> _left)").select(*keys, "_block").distinct()
        again = Stored(blocks.join(wrong, [*keys, "_block"], "left_semi"), "fusion-again")
        if again.df.isEmpty():
            again.release()
            return states
        # The first slice of a block enters as the one before was left, the others follow within the task.
        entry = F.when(F.col("_k") == 0, F.col("_in")).otherwise(F.col("_left"))
        chosen = again.df.select(*keys, "_k", entry.alias("_in"), (F.col("_k") % size == 0).alias("_lead"))
        headers = slices.join(chosen, [*keys, "_k"])
        part_rows = placed.join(again.df.select(*keys, "_k"), [*keys, "_k"], "left_semi")
        found = Stored(_scanned(part_rows, headers, keys, order, t, label, width, size), "fusion-states")
        kept = states.df.join(again.df.select(*keys, "_k"), [*keys, "_k"], "left_anti")
        merged = Stored(kept.unionByName(found.df), "fusion-states")
        for table in (states, again, found):
            table.release()
        states = merged


def _scanned(placed, headers, keys, order, t, label, width, size, channels=(), names=("acc", "gyro"), row=None) -> DataFrame:
    """The states of slices, or with ``channels`` their ticks.  A header opens each slice; a task goes on from slice to slice of a block."""
    emit = bool(channels)
    wanted = list(dict.fromkeys([*keys, "_k", "_sensor", *order, t, label, *channels]))
    extra = ["_own0", "_own1", "_rest0", "_rest1", "_lead"]
    opened = headers.select(*keys, "_k", F.lit(-1).alias("_sensor"), *extra, F.col("_in.*"))
    both = placed.select(*wanted).unionByName(opened, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    identity = [f"`{k}` {kinds[k]}" for k in keys]
    channel_names = [f"{name}_{c}" for name in names for c in channels]
    if emit:
        schema = ", ".join([*identity, "tick_t bigint", f"`{label}` {kinds[label]}", "fresh boolean", "first_row bigint", *[f"`{c}` double" for c in channel_names]])
    else:
        schema = ", ".join([*identity, "_k bigint", f"_in {STATE}", f"_out {STATE}"])
    state_type = pa.struct([(c, pa.int64()) for c in ("tag", "skip0", "skip1")])

    def scan(batches):
        state = None

        def finish(table: pa.Table, opens: np.ndarray) -> pa.RecordBatch:
            """Whole slices, one after the other; what can be told of all rows at once is told before."""
            nonlocal state
            sensor, places, labels = table.column("_sensor").to_numpy(), table.column(t).fill_null(0).to_numpy(), table.column(label).to_pylist()
            times = places.tolist()
            # Counts of label changes and of steps back in time; only differences between rows of one sensor are used.
            changes = [0, *accumulate(map(ne, labels, islice(labels, 1, None)))]
            falls = [0, *np.cumsum(places[1:] < places[:-1]).tolist()]
            seconds = (opens + np.add.reduceat((sensor <= 0).astype(np.int64), opens)).tolist()
            at, ends = opens.tolist(), [*opens[1:].tolist(), len(sensor)]
            heads = table.select([*extra, "tag", "skip0", "skip1"]).take(pa.array(opens)).to_pylist()
            entered, left, ticks = [], [], []
            for i, (head, start, second, end) in enumerate(zip(heads, at, seconds, ends)):
                bounds = ((start + 1, second), (second, end))
                if head["_lead"]:
                    state = (head["tag"], head["skip0"], head["skip1"])
                    if state[1] is None:
                        state = (state[0], *(taken_before(times[a:b], state[0]) for a, b in bounds))
                entered.append(state)
                own, rest = (head["_own0"], head["_own1"]), (head["_rest0"], head["_rest1"])
                found, state = scan_slice(times, labels, changes, falls, bounds, own, rest, width, state)
                left.append(state)
                ticks += [(start, *tick) for tick in found]
            if not emit:
                values = [pa.array([dict(zip(("tag", "skip0", "skip1"), s)) for s in states], state_type) for states in (entered, left)]
                columns = [table.column(c).combine_chunks().take(pa.array(opens)) for c in (*keys, "_k")]
                return pa.RecordBatch.from_arrays([*columns, *values], names=[*keys, "_k", "_in", "_out"])
            header = pa.array([x[0] for x in ticks], pa.int64())
            identity_columns = [table.column(c).combine_chunks().take(header) for c in keys]
            tags, fresh, spans = [x[1] for x in ticks], [x[2] for x in ticks], np.array([x[3:] for x in ticks], np.int64).reshape(-1, 4)
            first_rows, found = (table.column(c).combine_chunks().take(pa.array(spans[:, 0])) for c in (row or t, label))
            means = [pa.array(span_means(table.column(c), spans[:, 2 * i], spans[:, 2 * i + 1]), pa.float64(), from_pandas=True) for i in (0, 1) for c in channels]
            return pa.RecordBatch.from_arrays(
                [*identity_columns, pa.array(tags, pa.int64()), found, pa.array(fresh, pa.bool_()), first_rows.cast(pa.int64()), *means],
                names=[*keys, "tick_t", label, "fresh", "first_row", *channel_names])

        held, held_opens, held_rows = [], [], 0
        for batch in batches:
            opens = np.flatnonzero(batch.column("_sensor").to_numpy() == -1)
            if len(opens) and held_rows + opens[-1]:
                # The last slice may go on in the next batch.
                rows = pa.Table.from_batches([*held, batch.slice(0, int(opens[-1]))])
                yield finish(rows, np.array([*held_opens, *(opens[:-1] + held_rows)], np.int64))
                held, held_opens, held_rows = [], [0], 0
                batch = batch.slice(int(opens[-1]))
            elif len(opens):
                held_opens = [0]
            held.append(batch)
            held_rows += batch.num_rows
        if held_rows:
            yield finish(pa.Table.from_batches(held), np.array(held_opens, np.int64))

    block = F.floor(F.col("_k") / size)
    dealt = both.repartition(*keys, block).sortWithinPartitions(*keys, "_k", "_sensor", *order)
    return dealt.mapInArrow(scan, schema)


def taken_before(times: list[int], tag: int) -> int:
    """Rows at the front that lie before ``tag``."""
    return next((i for i, x in enumerate(times) if x >= tag), len(times))


def scan_slice(times, labels, changes, falls, bounds, own, rest, width, state):
    """Good ticks of a slice as ``(tag, fresh, from0, to0, from1, to1)``, and the state in which it is left.

    ``times`` and ``labels`` are columns, ``changes`` and ``falls`` count their label changes and steps back; ``bounds`` say
    where the rows of both sensors are: ``own`` rows of the slice and what follows within reach; ``rest`` rows follow in
    all.  The slice is done when its own rows are spent, and the scan when one sensor has no rows left.
    """
    tag, *skips = state
    (a0, b0), (a1, b1) = bounds
    own0, own1 = a0 + own[0], a1 + own[1]
    total0, total1 = own0 + rest[0], own1 + rest[1]
    rising0, rising1 = (a >= b or falls[a] == falls[b - 1] for a, b in bounds)
    at0, at1 = a0 + skips[0], a1 + skips[1]
    ticks = []
    while (at0 < own0 or at1 < own1) and at0 < total0 and at1 < total1:
        fresh = tag is None
        if fresh:
            tag = min(times[at] for at, b in ((at0, b0), (at1, b1)) if at < b)
        to0, to1 = rows_end(times, at0, b0, tag, width, rising0), rows_end(times, at1, b1, tag, width, rising1)
        good = to0 > at0 and to1 > at1 and changes[at0] == changes[to0 - 1] and changes[at1] == changes[to1 - 1]
        if good and labels[at0] is not None and labels[at0] == labels[at1]:
            ticks.append((tag, fresh, at0, to0, at1, to1))
            tag += width
        else:
            tag = None
        at0, at1 = to0, to1
    return ticks, (tag, max(at0 - own0, 0), max(at1 - own1, 0))


def rows_end(times: list[int], at: int, end: int, tag: int, width: int, rising: bool) -> int:
    """One past the rows from ``at`` on, before ``end``, that are less than ``width`` from ``tag``."""
    if at >= end or times[at] <= tag - width:
        return at
    if rising:
        return bisect_left(times, tag + width, at, end)
    while at < end and -width < times[at] - tag < width:
        at += 1
    return at


def span_means(column: pa.ChunkedArray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Means of rows ``start`` to ``end - 1``; spans do not overlap, and hold a row at least."""
    if not len(start):
        return np.zeros(0)
    values = np.append(column.cast(pa.float64()).to_numpy(), 0.0)
    edges = np.stack([start, end], 1).ravel()
    return np.add.reduceat(values, edges)[::2] / (end - start)
