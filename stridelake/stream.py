"""What a recording is: identity columns, an order, and time slices.

A recording can be far longer than one task should hold (one device may own a
third of all rows), so no operator here sorts a whole recording in one task.
A :class:`Stream` names a ``slice_width``: rows are partitioned by
``(keys, time div slice_width)`` and ordered inside that slice only.  What an
operator needs from outside the slice (how many rows came before, the last row
of the slice before, the run that is still open) comes from a summary with one
row per slice, which a map-side aggregation makes small before it is shuffled.

A sensor has a bounded rate, so ``rate x slice_width`` bounds the rows of a
slice.  For data without such a bound, ``largest_slices`` measures and
``fit_slices`` cuts the long recordings, and only those, each at places of its
own order.  A place is a time with its ties, so a burst gets as many slices as it
has rows for, even if all of them have one time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stridelake.sources.folders import stored

SLICE = "_slice"


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise, before any job starts, when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")


@dataclass(frozen=True)
class Stream:
    """Identity and order of recordings.

    keys         columns naming one recording; rows where one is null belong to none
    time         BIGINT column that leads the order (a time, or a file row number)
    ties         columns that make the order total
    slice_width  length of a slice, in the unit of ``time``
    cuts         set by :func:`fit_slices`: first places of slices per long recording (empty without any)
    cut_ties     the ties that the cuts were made with; under other ties, equal times share a slice
    """

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    slice_width: int = 3_600_000_000
    cuts: DataFrame | tuple | None = field(default=None, compare=False, repr=False)
    cut_ties: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.slice_width <= 0:
            raise ValueError("slice_width must be positive")

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.time, *self.ties]

    @property
    def slice_keys(self) -> list[str]:
        return [*self.keys, SLICE]

    def sliced(self, df: DataFrame) -> DataFrame:
        """Add the slice of each row."""
        if SLICE in df.columns:
            return df
        require_columns(df, self.columns)
        if self.cuts is None:
            t, width = F.col(self.time), F.lit(self.slice_width).cast("bigint")
            return df.withColumn(SLICE, ((t - F.pmod(t, width)) / width).cast("bigint"))
        whole = F.when(F.col(self.time).isNotNull(), F.lit(0).cast("bigint"))
        if not isinstance(self.cuts, DataFrame):
            return df.withColumn(SLICE, whole)
        places = F.transform("_cuts", lambda c: c["c0"]) if self.ties != self.cut_ties else F.col("_cuts")
        place = F.when(F.col("_cuts").isNull(), whole).otherwise(_not_above(places, self.place()))
        return df.join(self.cuts, list(self.keys), "left").select(*df.columns, F.when(F.col(self.time).isNotNull(), place).alias(SLICE))

    def place(self) -> Column:
        """What the cuts are compared with: the time, with its ties where those are the ones that made the cuts."""
        if self.ties != self.cut_ties:
            return F.col(self.time)
        return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate((self.time, *self.ties))])

    def whole_times(self) -> Stream:
        """The same recordings with slices that never part rows of one time."""
        return self if self.cuts is None or not self.cut_ties else replace(self, cut_ties=("",))

    def in_slice(self) -> WindowSpec:
        return Window.partitionBy(*self.slice_keys).orderBy(self.time, *self.ties)

    def across_slices(self) -> WindowSpec:
        """For slice summaries only: one row per slice, never the samples."""
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def ordered_by(self, time: str, ties: tuple[str, ...] = ()) -> Stream:
        """The same recordings and slices under another name of the time and other ties."""
        return replace(self, time=time, ties=ties)


def largest_slices(df: DataFrame, stream: Stream, k: int = 10) -> DataFrame:
    """The ``k`` fullest slices: choose ``slice_width`` so that these fit a task."""
    return (
        stream.sliced(df)
        .groupBy(*stream.slice_keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), *stream.slice_keys)
        .limit(k)
    )


def _not_above(sorted_: Column, value: Column) -> Column:
    """How many entries of a sorted array are no greater than ``value``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_) + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("low"), F.size(sorted_).cast("bigint").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        done, goes = s["low"] >= s["high"], F.get(sorted_, middle) <= value
        low = F.when(done | ~goes, s["low"]).otherwise(middle + 1)
        high = F.when(done | goes, s["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(steps, start, halve, lambda s: s["low"])


#: Rows picked for each slice that a long recording is cut into.
PICKS = 32


def fit_slices(df: DataFrame, stream: Stream, max_rows: int = 5_000_000) -> Stream:
    """``stream`` with slices cut so that a slice holds about ``max_rows`` rows, whatever the times.

    Recordings of up to ``max_rows`` rows stay whole.  Of the longer ones, of which there are at most
    ``rows / max_rows``, rows picked by a hash of their place sample the order, ``PICKS`` for each slice of half that size;
    every ``PICKS``-th is a cut.  The order is that of time and ties: only rows that agree in both stay together.
    Runs jobs now; what it finds is a table that the result refers to.
    """
    require_columns(df, stream.columns)
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    sizes = df.filter(F.col(stream.time).isNotNull()).groupBy(*stream.keys).agg(F.count(F.lit(1)).alias("_rows"))
    long = stored(sizes.filter(F.col("_rows") > max_rows).select(*stream.keys), "long-recordings")
    if long.isEmpty():
        return replace(stream, cuts=(), cut_ties=stream.ties)
    share = min(1.0, 2 * PICKS / max_rows)
    place = F.pmod(F.xxhash64(*stream.columns), F.lit(1 << 40))
    picked = df.filter(F.col(stream.time).isNotNull() & (place < int(share * (1 << 40)))).join(long, list(stream.keys), "left_semi")
    of_recording = Window.partitionBy(*stream.keys).orderBy(stream.time, *stream.ties)
    every = max(1, round(share * max_rows / 2))
    named = replace(stream, cut_ties=stream.ties)
    cuts = picked.select(*stream.keys, named.place().alias("_place"), F.row_number().over(of_recording).alias("_n")).filter(F.col("_n") % every == 0)
    table = stored(cuts.groupBy(*stream.keys).agg(F.array_sort(F.collect_set("_place")).alias("_cuts")), "cuts")
    return replace(named, cuts=table)
