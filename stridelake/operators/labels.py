"""Label encodings and per-window labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators.ranges import rank_by_ranges
from stridelake.stream import require_columns


#: A vocabulary up to this size is broadcast; a larger one is joined by shuffling.
MAX_BROADCAST = 100_000


def _sized(codes: DataFrame, vocabulary: DataFrame, small: bool | None) -> DataFrame:
    """A hint for a vocabulary that is known to be small; without a word from the caller, one small job counts up to the bound."""
    if small is None:
        small = vocabulary.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return F.broadcast(codes) if small else codes


def encode_sorted(df: DataFrame, column: str, out: str | None = None, small: bool | None = None) -> DataFrame:
    """Codes 0, 1, ... in the lexicographic order of the label text, for a vocabulary of any size.

    ``small`` says whether it has ``MAX_BROADCAST`` entries at most; nothing runs while the plan is built if it is given.
    """
    out = out or f"{column}_id"
    require_columns(df, [column])
    vocabulary = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.join(_sized(rank_by_ranges(vocabulary, [column], out), vocabulary, small), column, "left")


def encode_vocab(
    df: DataFrame, column: str, vocabulary: Sequence[str], match: str = "exact", out: str | None = None
) -> DataFrame:
    """Codes by place in a given list, by equality or by prefix; unknown text gets null."""
    if match not in ("exact", "prefix"):
        raise ValueError("match is exact or prefix")
    text = F.col(column)
    code = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(vocabulary))):
        hit = text == name if match == "exact" else text.startswith(name)
        code = F.when(hit, F.lit(i)).otherwise(code)
    return df.withColumn(out or f"{column}_id", code)


def unknown_labels(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Texts that :func:`encode_vocab` left without a code, with their counts."""
    return df.filter(F.col(code or f"{column}_id").isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def encode_first_seen(df: DataFrame, column: str, order: Sequence[str], out: str | None = None, small: bool | None = None) -> DataFrame:
    """Codes 1, 2, ... in the order in which labels first occur, for a vocabulary of any size.

    Labels that first occur at equal values of ``order`` follow their text.  ``small`` as in :func:`encode_sorted`.
    """
    out = out or f"{column}_id"
    require_columns(df, [column, *order])
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    codes = rank_by_ranges(first, ["_first", column], out, 1).drop("_first")
    return df.join(_sized(codes, first.select(column), small), column, "left")


def zero_base(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract each column's smallest value, found once and passed on as a scalar."""
    require_columns(df, columns)
    lowest = df.agg(F.struct(*[F.min(c).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.col(c) - lowest[c] for c in columns})


def composite_label(df: DataFrame, columns: Sequence[str], out: str = "composite") -> DataFrame:
    """Label kinds as decimal digits of one number, the first the highest."""
    require_columns(df, columns)
    total = F.lit(0).cast("bigint")
    for c in columns:
        total = total * 10 + F.col(c)
    return df.withColumn(out, total)


def window_label(long: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """A window's label: that of its first step."""
    return long.groupBy(*keys).agg(F.min_by(label, "step").alias(label))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def resolve_label(names: Sequence[str], text: str) -> int:
    """A label given as digits or as a name, as its id."""
    if text.isdigit():
        if int(text) < len(names):
            return int(text)
        raise ValueError(f"label id {text} is out of range, {len(names)} labels are known")
    if text not in names:
        raise ValueError(f"unknown label {text!r}, known: {list(names)}")
    return list(names).index(text)
