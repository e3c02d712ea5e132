"""The test tables in the roles of recordings, label streams, windows and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake import Stream
from stridelake.operators.columns import flatten_steps, reshape_vector

HOUR = 3_600_000_000
DAY = 24 * HOUR
CHANNELS = [f"c{i}" for i in range(6)]

# A user's events as one recording; a week of it per slice.
EVENTS = Stream(("user_id",), "t_us", ("event_id",), 7 * DAY)
# A supplier's line items as one recording, in days; a year of it per slice.
ITEMS = Stream(("l_suppkey",), "day", ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 365)

# The statements below open with these.
EV = """ev as (
  select user_id, event_id, epoch_us(ts) as t_us, value,
         cast(json_extract_string(props, '$.k') as double) as k, event_type
  from events)"""
EVN = EV + """,
evn as (
  select *, row_number() over (partition by user_id order by t_us, event_id) - 1 as seq,
         count(*) over (partition by user_id) as n
  from ev)"""
LI = """li as (
  select l_suppkey, date_diff('day', timestamp '1970-01-01', l_shipdate) as day, l_orderkey, l_linenumber,
         l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag
  from lineitem)"""
LIN = LI + """,
lin as (
  select *, row_number() over (partition by l_suppkey
                               order by day, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as seq,
         count(*) over (partition by l_suppkey) as n
  from li)"""
WIN = """win as (
  select vec_id as window_id, label, t.i // 6 as step, t.i % 6 as ch, coalesce(cast(embedding[t.i + 1] as double), 0) as v
  from embeddings, range(72) t(i))"""
PRED = """cells as (
  select vec_id, label, t.i as i, cast(embedding[t.i + 1] as double) as v from embeddings, range(64) t(i)),
centroids as (select label as class, i, avg(v) as c from cells group by 1, 2),
scored as (
  select e.vec_id as window_id, e.label, c.class, round(sum(e.v * c.c), 9) as score
  from cells e join centroids c on e.i = c.i group by 1, 2, 3),
pred as (
  select window_id, label, arg_min(class, (-score, class)) as predicted from scored group by 1, 2)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(column: str) -> Column:
    """Microseconds of a wall-clock timestamp, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id", "event_id", epoch_us("ts").alias("t_us"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type",
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"), "l_orderkey",
        "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag",
    )


def windows(spark: SparkSession, folder: str, steps: int = 12, channels: int = 6) -> DataFrame:
    """The 64 numbers of each vector, zeros up to 72, as windows."""
    size = steps * channels
    cells = F.col("embedding").cast("array<double>")
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(cells)))), 1, size)
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("window_id"), "label", reshape_vector(padded, steps, channels).alias("data")
    )


def windows_long(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_steps(windows(spark, folder), CHANNELS)


def tall(df: DataFrame, keys: list[str], data: str = "data", step: str = "step", channel: str = "ch", value: str = "v") -> DataFrame:
    """Windows in array form as one row per value, for comparison with SQL."""
    return df.select(*keys, F.posexplode(data).alias(step, "_row")).select(
        *keys, F.col(step).cast("bigint").alias(step), F.posexplode("_row").alias(channel, value)
    ).withColumn(channel, F.col(channel).cast("bigint"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors scored against the mean vector of each label: ``scores`` and ``label``."""
    vectors = table(spark, folder, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    # One row: as many numbers as labels times channels.
    table_of_means = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centroid")
    ).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all")).scalar()

    def dot(centroid: Column) -> Column:
        products = F.zip_with("embedding", centroid, lambda a, b: a.cast("double") * b)
        return F.round(F.aggregate(products, F.lit(0.0), lambda s, v: s + v), 9)

    return vectors.withColumn("_means", table_of_means).select(
        F.col("vec_id").alias("window_id"), "label",
        F.transform("_means", lambda m: dot(m["centroid"])).alias("scores"),
    )


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    ).select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))
