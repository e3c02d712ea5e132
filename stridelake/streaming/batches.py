"""Streams whose batches write tables: late rows apart, and windows by arrival.

A stateful operator of a streaming plan sees the rows of a key unsorted and drops late ones unseen.  Here each micro-batch
is an ordinary DataFrame (``foreachBatch``): it is split, sorted and numbered by slices like any table, so no task holds
what a batch brings of one recording.  What the next batch has to know is a table of this batch.

All tables are written once per batch number: staged, then renamed.  A batch that runs again after a failure finds what
it wrote and goes on, and later batches read the tables of the one before, so a restart gives the same rows.  The folder
must be one whose renames are atomic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stridelake.operators.ordered import number_rows
from stridelake.stream import Stream, require_columns


class BatchTables:
    """Tables ``folder/name/batch=<number>``, each there in whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def place(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def has(self, name: str, batch: int) -> bool:
        path, files = self._path(self.place(name, batch))
        return files.exists(path)

    def stage(self, df: DataFrame, name: str) -> str:
        staged = f"{self.folder}/_staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        return staged

    def settle(self, staged: str, name: str, batch: int) -> None:
        path, files = self._path(self.place(name, batch))
        files.mkdirs(path.getParent())
        if not files.rename(self._path(staged)[0], path):
            raise OSError(f"{staged} could not be renamed to {path}")

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """``df`` as this batch's table, unless it is there; read back."""
        if not self.has(name, batch):
            self.settle(self.stage(df, name), name, batch)
        return self.read(name, batch, df.schema)

    def read(self, name: str, batch: int, schema: T.StructType | str) -> DataFrame:
        """The batch's table; without rows if there is none."""
        if not self.has(name, batch):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.place(name, batch))

    def forget(self, name: str, batch: int) -> None:
        path, files = self._path(self.place(name, batch))
        files.delete(path, True)


def all_batches(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame:
    """What all batches wrote to the table ``name``."""
    tables = BatchTables(spark, folder)
    path, files = tables._path(f"{folder}/{name}")
    return spark.read.schema(schema).parquet(f"{folder}/{name}/*") if files.exists(path) else spark.createDataFrame([], schema)


def admit(df: DataFrame, folder: str, checkpoint: str, time: str, closes: Column, delay: str) -> StreamingQuery:
    """Split a stream by the watermark: rows in time go to ``folder/accepted``, late ones to ``folder/late``.

    The watermark of a batch is the greatest ``time`` of the batches before, less ``delay``.  A row is late if the place
    it belongs to closes at or before that: ``closes`` is the end of its bucket, or its time and the gap of a session.
    Every row of the feed is in one of the two; one without a time is late.  A stream over ``accepted`` with the same
    delay (:func:`accepted`) drops none.  Takes what is there and stops.
    """
    require_columns(df, [time])
    schema = df.schema

    def split(batch: DataFrame, number: int) -> None:
        tables = BatchTables(batch.sparkSession, folder)
        if tables.has("accepted", number):
            return
        before = tables.read("marks", number - 1, "reached timestamp").first()
        reached = before[0] if before else None
        # Both sides of the comparison stay in Spark: a driver's clock has no part in it.
        marked = batch.withColumn("_mark", F.lit(reached).cast("timestamp") - F.expr(f"interval {delay}"))
        # Rows without a time go around the rule: a window in it would leave them out.
        timeless, timed = marked.filter(F.col(time).isNull()), marked.filter(F.col(time).isNotNull())
        late = F.coalesce(closes <= F.col("_mark"), F.lit(False))
        tables.write(timed.filter(late).select(*schema.names).unionByName(timeless.select(*schema.names)), "late", number)
        seen = Observation()
        staged = tables.stage(timed.filter(~late).select(*schema.names).observe(seen, F.max(time).alias("reached")), "accepted")
        found = [x for x in (reached, seen.get["reached"]) if x is not None]
        tables.write(batch.sparkSession.createDataFrame([(max(found, default=None),)], "reached timestamp"), "marks", number)
        tables.settle(staged, "accepted", number)
        tables.forget("marks", number - 2)

    return df.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows in time as a stream."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.readStream.schema(with_batch).parquet(f"{folder}/accepted").drop("batch")


def bucket_closes(time: str, bucket: str) -> Column:
    """The end of the bucket that :func:`stream_resample` puts a row into."""
    return F.window(time, bucket)["end"]


def windows_by_arrival(
    df: DataFrame, folder: str, checkpoint: str, stream: Stream, channels: Sequence[str], size: int, hop: int,
    out: str = "data", then: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Every full window of ``size`` rows per recording, written to ``folder/windows`` by the batch that completes it.

    Rows count in the order in which batches bring them; those of one batch are put in the stream's order.  A row whose
    time lies before the last one counted is late (one of equal time is not): it goes to ``folder/late``, as do rows
    without identity or time.  Windows hold ``keys, window_no, first_order, <out>``; ``then`` is applied to them, for
    instance a batch scorer.  A batch is numbered by slices and windows gather by ``(keys, window_no)``; from one batch to
    the next go a row per recording and its fewer than ``size + hop`` last rows.  Takes what is there and stops.
    """
    if size <= 0 or hop <= 0:
        raise ValueError("size and hop must be positive")
    require_columns(df, [*stream.columns, *channels])
    keys, t = list(stream.keys), stream.time
    row_schema = df.select(*dict.fromkeys([*stream.columns, *channels])).schema
    key_schema = [df.schema[k] for k in keys]
    long = T.LongType()
    counts = T.StructType([*key_schema, T.StructField("_taken", long), T.StructField("_last", long)])
    tails = T.StructType([*row_schema.fields, T.StructField("_seq", long), T.StructField("_next", long)])

    def first_open(taken: Column) -> Column:
        """The first window that ``taken`` rows do not fill."""
        return F.when(taken >= size, F.floor((taken - size) / hop) + 1).otherwise(0).cast("bigint")

    def advance(batch: DataFrame, number: int) -> None:
        tables = BatchTables(batch.sparkSession, folder)
        if tables.has("recordings", number):
            return
        known = tables.read("recordings", number - 1, counts)
        tail = tables.read("tail", number - 1, tails)
        rows = batch.select(*row_schema.names)
        placed = F.lit(True)
        for c in (*keys, t):
            placed = placed & F.col(c).isNotNull()
        in_order = number_rows(rows.filter(placed), stream, attach=known)
        behind = F.coalesce(F.col(t) < F.col("_last"), F.lit(False))
        late = in_order.filter(behind).select(*row_schema.names).unionByName(rows.filter(~placed))
        tables.write(late, "late", number)
        in_time = number_rows(in_order.filter(~behind).drop("seq", "n"), stream)
        taken = F.coalesce("_taken", F.lit(0).cast("bigint"))
        counted = in_time.withColumns({"_seq": taken + F.col("seq"), "_all": taken + F.col("n")}).select(*row_schema.names, "_seq", "_all")
        fresh = tables.write(counted, "fresh", number)
        gained = fresh.groupBy(*keys).agg(F.max("_all").alias("_gained"), F.max(F.col(t).cast("bigint")).alias("_reached"))
        joined = known.join(gained, keys, "full").select(*keys, F.coalesce("_gained", "_taken").alias("_taken"), F.coalesce("_reached", "_last").alias("_last"))
        now = tables.write(joined, "counted", number)
        # Rows of earlier batches take part in windows that were open; a recording has few of them.
        old = tail.join(now.select(*keys, F.col("_taken").alias("_all")), keys)
        held = old.unionByName(fresh.withColumn("_next", F.lit(0).cast("bigint")))
        low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("_seq") - (size - 1)) / hop), F.col("_next"))
        high = F.floor(F.col("_seq") / hop)
        in_windows = held.withColumns({"_low": low, "_high": high}).filter("_low <= _high").withColumn("window_no", F.explode(F.sequence("_low", "_high")))
        full = in_windows.filter(F.col("window_no") * hop + size <= F.col("_all"))
        cells = F.array(*[F.col(c).cast("double") for c in channels])
        order = F.struct((F.col("_seq") - F.col("window_no") * hop).alias("step"), F.col(t).cast("bigint").alias("t"), cells.alias("cells"))
        windows = full.groupBy(*keys, "window_no").agg(F.array_sort(F.collect_list(order)).alias("_rows")).select(
            *keys, "window_no", F.col("_rows")[0]["t"].alias("first_order"), F.col("_rows.cells").alias(out))
        tables.write(then(windows) if then else windows, "windows", number)
        after = first_open(F.col("_all"))
        kept = held.withColumn("_next", after).filter(F.col("_seq") >= F.col("_next") * hop).select(*tails.names)
        tables.write(kept, "tail", number)
        tables.write(now, "recordings", number)
        for name in ("fresh", "counted"):
            tables.forget(name, number)
        for name in ("recordings", "tail"):
            tables.forget(name, number - 2)

    return df.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
