"""Rank and running sums in one order over a whole table, by range partitions.

Rows are dealt by ranges of the order and sorted once; a row's place is its place in the partition plus the rows of the
partitions before.  Those offsets are one row per partition.  Nothing runs while the plan is built.

The partition sizes and the rows come from one exchange, which Spark reuses as long as both read the same columns: the
sizes carry a checksum of all of them.  Were it run twice, its sampled bounds might differ, so each row is checked against
the bounds of its partition, and a row beyond them ends the query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that count rows of a partition.
PLACE_BITS = 33


def _ranged(df: DataFrame, order: Sequence[str], descending: bool, ranges: int | None) -> DataFrame:
    """Sorted range partitions; ``_at`` holds the partition and the place in it."""
    toward = [F.desc(c) if descending else F.asc(c) for c in order]
    # A given number of partitions is one that adaptive execution keeps.
    number = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(number, *toward).sortWithinPartitions(*toward).withColumn("_at", F.monotonically_increasing_id())


def _part() -> Column:
    return F.shiftright("_at", PLACE_BITS)


def _bounds(order: Sequence[str], columns: Sequence[str]) -> list[Column]:
    value = F.struct(*order)
    return [F.min(value).alias("_least"), F.max(value).alias("_most"), F.bit_xor(F.xxhash64(*columns)).alias("_sum")]


def _with_offsets(placed: DataFrame, offsets: DataFrame, order: Sequence[str]) -> DataFrame:
    value = F.struct(*order)
    inside = (value >= F.col("_least")) & (value <= F.col("_most")) & F.col("_sum").isNotNull()
    # Every offset goes through the check, so the optimiser cannot leave it out.
    checked = F.when(inside, F.col("_part")).otherwise(F.raise_error(F.lit("range partitions were computed twice and differ")).cast("bigint"))
    return placed.withColumn("_part", _part()).join(offsets, "_part").withColumn("_part", checked).filter("_part >= 0").drop("_least", "_most", "_sum")


def rank_by_ranges(df: DataFrame, order: Sequence[str], out: str, start: int = 0, ranges: int | None = None) -> DataFrame:
    """Add the row's place in ``order``, counted from ``start``; the order must be total for a definite result."""
    placed = _ranged(df, order, False, ranges)
    sizes = placed.groupBy(_part().alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), *_bounds(order, df.columns))
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", "_least", "_most", "_sum", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_base"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return _with_offsets(placed, offsets, order).select(*df.columns, (F.col("_base") + place + start).alias(out))


def sums_by_ranges(df: DataFrame, order: Sequence[str], sums: Mapping[str, str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add, for each ``{name: column}`` of whole numbers, ``<name>_before`` (the sum over rows earlier in ``order``) and ``<name>_total``."""
    placed = _ranged(df, order, descending, ranges)
    sizes = placed.groupBy(_part().alias("_part")).agg(*[F.sum(c).alias(f"_run_{name}") for name, c in sums.items()], *_bounds(order, df.columns))
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    offsets = sizes.select(
        "_part", "_least", "_most", "_sum", *[F.coalesce(F.sum(f"_run_{n}").over(earlier), zero).alias(f"_base_{n}") for n in sums],
        *[F.sum(f"_run_{n}").over(whole).alias(f"{n}_total") for n in sums])
    names = [*placed.columns, *[f"_run_{n}" for n in sums]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema] + [f"`_run_{n}` bigint" for n in sums])
    columns = list(sums.values())

    def running(batches):
        so_far = np.zeros(len(columns), np.int64)
        for batch in batches:
            values = [np.asarray(batch.column(c).fill_null(0)).astype(np.int64) for c in columns]
            before = [pa.array(s + np.cumsum(v) - v) for s, v in zip(so_far, values)]
            so_far += [int(v.sum()) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, *before], names=names)

    joined = _with_offsets(placed.mapInArrow(running, schema), offsets, order)
    return joined.select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_run_{n}")).alias(f"{n}_before") for n in sums], *[f"{n}_total" for n in sums])
