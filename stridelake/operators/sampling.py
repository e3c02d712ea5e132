"""Shuffles, splits and balanced samples that repeat exactly.

The random order is that of ``md5(seed:id)``, so it does not depend on how the
rows are partitioned.  The digest is uniform: its leading digits cut any table,
or any class of a table, into pieces of about the same size, and exact ranks need
the piece totals and one sort per piece, never one sort of everything in a task.
``key`` is unique in every function here; rows that belong together (a user's
windows) are split together with :func:`assign_split` over the distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.stream import require_columns



def random_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``parts`` only."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _piece(digits: int) -> Column:
    return F.substring("_order", 1, digits)


def random_ranks(df: DataFrame, key: str, seed: int, within: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Add ``rank`` (0-based, by random key) and ``total``, over all rows or per ``within``.

    ``16 ** digits`` pieces per group; the totals that a task sees are that many.
    """
    require_columns(df, [key, *within])
    if not 1 <= digits <= 5:
        raise ValueError("digits is 1 to 5")
    keyed = df.withColumn("_order", random_key(seed, key)).withColumn("_piece", _piece(digits))
    pieces = [*within, "_piece"]
    sizes = keyed.groupBy(*pieces).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        *pieces,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(*within)).alias("total"),
    )
    local = F.row_number().over(Window.partitionBy(*pieces).orderBy("_order", key))
    return keyed.withColumn("_local", local).join(base, pieces).select(
        *df.columns, (F.col("_base") + F.col("_local") - 1).alias("rank"), "total"
    )


def shuffle(df: DataFrame, key: str, seed: int, digits: int = 4) -> DataFrame:
    """Add ``position``: where a joint shuffle of data and labels puts the row."""
    return random_ranks(df, key, seed, (), digits).withColumnRenamed("rank", "position").drop("total")


def _whole(total: Column, rate: float) -> Column:
    return F.floor(total * F.lit(float(rate))).cast("bigint")


def _cut_rows(df: DataFrame, key: str, seed: int, within: Sequence[str], wanted: DataFrame, digits: int) -> DataFrame:
    """The row at each wanted rank: ``within, want, cut`` where ``cut`` is its place in the random order.

    ``wanted`` has ``within, _piece, want, _offset``, the piece that holds the rank
    and the place inside it: a row per want, which is broadcast, or per want
    and group, which is left to the optimiser.  Only those pieces are shuffled and sorted.
    """
    keyed = df.select(*within, key).withColumn("_order", random_key(seed, key)).withColumn("_piece", _piece(digits))
    local = F.row_number().over(Window.partitionBy(*within, "want").orderBy("_order", key)) - 1
    return keyed.join(wanted if within else F.broadcast(wanted), [*within, "_piece"]).withColumn("_local", local).filter(
        "_local = _offset"
    ).select(*within, "want", F.struct("_order", key).alias("cut"))


def _piece_bounds(df: DataFrame, key: str, seed: int, within: Sequence[str], digits: int) -> DataFrame:
    """Pieces of the random order with ``_base`` rows before them and ``total`` of their group."""
    keyed = df.select(*within, key).withColumn("_order", random_key(seed, key)).withColumn("_piece", _piece(digits))
    sizes = keyed.groupBy(*within, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *within, "_piece", "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_rows").over(Window.partitionBy(*within)).alias("total"),
    )


def _at_ranks(bounds: DataFrame, within: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """The pieces that hold the wanted ranks; a rank past the last row is in none."""
    wants = F.array(*[F.struct(F.lit(name).alias("want"), rank.alias("at")) for name, rank in ranks.items()])
    return bounds.withColumn("_w", F.explode(wants)).filter(
        (F.col("_w.at") >= F.col("_base")) & (F.col("_w.at") < F.col("_base") + F.col("_rows"))
    ).select(*within, "_piece", F.col("_w.want").alias("want"), (F.col("_w.at") - F.col("_base")).alias("_offset"))


def _here(seed: int, key: str) -> Column:
    """A row's place in the random order."""
    return F.struct(random_key(seed, key).alias("_order"), F.col(key).alias(key))


def _cuts(df: DataFrame, key: str, seed: int, ranks: dict[str, Column], digits: int) -> Column:
    """The places of the rows at the wanted ranks, as one scalar struct; null past the last row.

    Whoever compares a row's place with it needs no shuffle of the rows.
    """
    wanted = _at_ranks(_piece_bounds(df, key, seed, (), digits), (), ranks)
    return _cut_rows(df, key, seed, (), wanted, digits).agg(
        F.struct(*[F.max(F.when(F.col("want") == name, F.col("cut"))).alias(name) for name in ranks])
    ).scalar()


def _below(place: Column, cut: Column) -> Column:
    return F.coalesce(place < cut, F.lit(True))


def assign_split(
    df: DataFrame, ids: DataFrame, key: str, seed: int, train: float = 0.8, vali: float = 0.1, digits: int = 4
) -> DataFrame:
    """Add ``split`` to rows by their ``key``; the exact sizes are those of ``ids``, one row per key."""
    n_train, n_vali = _whole(F.col("total"), train), _whole(F.col("total"), vali)
    cuts = _cuts(ids, key, seed, {"train": n_train, "vali": n_train + n_vali}, digits)
    place = F.col("_place")
    part = F.when(_below(place, cuts["train"]), "train").when(_below(place, cuts["vali"]), "vali").otherwise("test")
    return df.withColumn("_place", _here(seed, key)).withColumn("split", part).drop("_place")


def split(df: DataFrame, key: str, seed: int, train: float = 0.8, vali: float = 0.1, digits: int = 4) -> DataFrame:
    """Add ``split``: exactly int(N*train) train rows, int(N*vali) vali rows, the rest test."""
    return assign_split(df, df, key, seed, train, vali, digits)


def split_fast(df: DataFrame, key: str, seed: int, train: float = 0.8, vali: float = 0.1) -> DataFrame:
    """Like :func:`split` with sizes met on average only, and no shuffle."""
    u = hash_uniform(seed, key)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + vali, "vali").otherwise("test"))


def pretrain_split(df: DataFrame, key: str, seed: int, train: float = 0.8, digits: int = 4) -> DataFrame:
    """The train part and the tenth used for validation; the rest is left alone."""
    return split(df, key, seed, train, 0.1, digits).filter(F.col("split") != "test")


def labelled_flag(df: DataFrame, key: str, rate: float, seed: int, digits: int = 4) -> Column:
    """Whether a row of ``df`` is among exactly int(N*rate) random ones."""
    cuts = _cuts(df, key, seed, {"labelled": _whole(F.col("total"), rate)}, digits)
    return _below(_here(seed, key), cuts["labelled"])


def sample_labelled(df: DataFrame, key: str, rate: float, seed: int, digits: int = 4) -> DataFrame:
    """Add ``labelled``: true for exactly int(N*rate) rows."""
    return df.withColumn("labelled", labelled_flag(df, key, rate, seed, digits))


def balanced_quota(df: DataFrame, label: str, rate: float) -> DataFrame:
    """One row: rows per class to take, whether that uses up the smallest class, classes, rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    totals = counts.agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("_rows").alias("smallest")
    )
    fair = F.floor(F.col("n_rows") * F.lit(float(rate)) / F.col("n_classes")).cast("bigint")
    return totals.withColumn("quota", F.least("smallest", fair)).withColumn(
        "uses_all_of_smallest", F.col("quota") == F.col("smallest")
    )


def balanced_cuts(df: DataFrame, key: str, label: str, rate: float, seed: int, digits: int = 4) -> DataFrame:
    """``label, cut``: one row per class, the place in the random order below which its rows are taken."""
    known = df.filter(F.col(label).isNotNull())
    bounds = _piece_bounds(known, key, seed, [label], digits)
    totals = bounds.groupBy(label).agg(F.max("total").alias("total"))
    fair = F.least(F.min("total"), F.floor(F.sum("total") * F.lit(float(rate)) / F.count(F.lit(1))).cast("bigint"))
    wanted = _at_ranks(bounds.withColumn("_quota", totals.agg(fair).scalar()), [label], {"labelled": F.col("_quota")})
    return _cut_rows(known, key, seed, [label], wanted, digits).select(label, "cut")


def with_balanced_flag(df: DataFrame, cuts: DataFrame, key: str, label: str, seed: int, flag: str = "labelled") -> DataFrame:
    """Mark the rows that :func:`balanced_cuts` takes, for any number of classes; a row without a class is never taken.

    The join is left to the optimiser: few classes are sent to every task.
    """
    # A class without a cut is taken whole.
    joined = df.join(cuts, label, "left").withColumn("_place", _here(seed, key))
    taken = F.col(label).isNotNull() & _below(F.col("_place"), F.col("cut"))
    return joined.withColumn(flag, taken).select(*df.columns, flag)


def sample_balanced(df: DataFrame, key: str, label: str, rate: float, seed: int, digits: int = 4) -> DataFrame:
    """Add ``labelled``: true for the same number of rows of every class."""
    return with_balanced_flag(df, balanced_cuts(df, key, label, rate, seed, digits), key, label, seed)


def balanced_report(sampled: DataFrame) -> DataFrame:
    """Rows with and without label and the real label rate."""
    taken = F.sum(F.col("labelled").cast("bigint"))
    rows = F.count(F.lit(1))
    return sampled.agg(
        taken.alias("labelled_rows"), (rows - taken).alias("unlabelled_rows"), (taken / rows).alias("label_rate")
    )


def take_random(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in random order: a top-k, every task keeps at most ``k``."""
    return df.withColumn("_order", random_key(seed, key)).orderBy("_order", key).limit(k).drop("_order")
