"""Bounded training samples."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def id_remainder(modulus: int) -> Column:
    """crc32 of ``doc_id`` as text, by ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def bounded(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows of ``df``, or about ``bound`` of them picked by a hash of ``key`` (the same ones every time)."""
    n = df.count()
    return df if n <= bound else df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def stratified(df: DataFrame, by: str, bound: int, least: int) -> tuple[list, DataFrame]:
    """The distinct values of ``by``, sorted, and of each all rows or about as many as fit, picked by a hash of the row.

    The rows a value may have are the same for all values: as many as keep the sum near ``bound``, but ``least`` at least.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    room, quota = bound, bound
    for i, n in enumerate(sorted(counts.values())):
        quota = room // (len(counts) - i)
        if n > quota:
            break
        room -= n
    quota = max(quota, least)
    whole = 1 << 40
    shares = [F.lit(x) for value, n in counts.items() if n > quota for x in (value, whole * quota // n)]
    if shares:
        place = F.pmod(F.xxhash64(F.lit("sample"), *(c for c in df.columns if c != by)), F.lit(whole))
        df = df.where(place < F.coalesce(F.create_map(*shares)[F.col(by)], F.lit(whole)))
    return sorted(counts), df
