"""Window sets and predictions as Parquet, and the import of array files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.columns import truncate_channels
from stridelake.operators.quality import summary_from, summary_metrics

PARTITIONS = ("dataset", "rate_hz", "window", "step")


#: Folder of a window set's manifest: a row per write, in files that are there in whole or not at all.
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "dataset string, rate_hz int, window int, step int, version string, at bigint, replaces boolean"


def write_windows(
    df: DataFrame, path: str, dataset: str, rate_hz: int, window: int, step: int, mode: str = "replace",
    labels: Sequence[str] | None = None,
) -> dict | None:
    """Write windows with their labels as a version of a set; values are stored as 32-bit floats.

    Rate, window and step are partition columns of their own, so reading one version touches its files only.  A write
    goes to a folder of its own and counts once its manifest row is there, the last thing written: a write that failed, or
    runs again, leaves nothing behind that readers see.  ``replace`` takes the place of what the set had under the same
    four values, ``append`` adds to it; other versions and other sets stay as they are.

    With ``labels``, the summary of what was written comes from the writing job itself (see ``summary_metrics``).
    """
    if mode not in ("replace", "append"):
        raise ValueError("mode is replace or append")
    values, version = (dataset, rate_hz, window, step), uuid.uuid4().hex
    stored = df.withColumn("data", F.col("data").cast("array<array<float>>"))
    seen = Observation()
    if labels is not None:
        metrics = summary_metrics(labels)
        stored = stored.observe(seen, *metrics)
    tagged = stored.withColumns({name: F.lit(value) for name, value in zip((*PARTITIONS, "version"), (*values, version))})
    tagged.write.mode("append").partitionBy(*PARTITIONS, "version").parquet(path)
    entry = df.sparkSession.createDataFrame([(*values, version, time.time_ns(), mode == "replace")], MANIFEST_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return None if labels is None else summary_from(seen.get, labels)


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows that count: of each set's version the last replacing write and what was appended since."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")
    last = rows.filter("replaces").groupBy(*PARTITIONS).agg(F.max("at").alias("_since"))
    return rows.join(last, list(PARTITIONS), "left").filter(F.col("_since").isNull() | (F.col("at") >= F.col("_since"))).drop("_since")


def read_windows(
    spark: SparkSession, path: str, dataset: str | None = None, rate_hz: int | None = None, window: int | None = None,
    step: int | None = None,
) -> DataFrame:
    """The windows that count now, of all sets or of those chosen; folders of other versions are not opened."""
    wanted = [(name, value) for name, value in zip(PARTITIONS, (dataset, rate_hz, window, step)) if value is not None]
    live = live_versions(spark, path)
    df = spark.read.parquet(path)
    for name, value in wanted:
        live, df = live.filter(F.col(name) == value), df.filter(F.col(name) == value)
    # A row per write: as many as someone wrote versions.
    return df.filter(F.col("version").isin([r.version for r in live.select("version").collect()])).drop("version")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete folders that no manifest row counts any more; call it when no reader of them is left."""
    live = {r.version for r in live_versions(spark, path).collect()}
    gone = 0
    for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}").collect():
        if r.version not in live:
            folder = "/".join([path, *[f"{name}={r[name]}" for name in (*PARTITIONS, "version")]])
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            gone += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def import_npy(spark: SparkSession, path: str, channels: int, slice_rows: int = 256) -> DataFrame:
    """Array files (windows, steps, channels) as rows ``file, window_no, data``; one file per task.

    A file of another rank, or with fewer channels, fails the query; extra
    channels are cut off.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                values = np.load(BytesIO(content), allow_pickle=False)
                if values.ndim != 3:
                    raise ValueError(f"{name}: expected rank 3, got shape {values.shape}")
                for start in range(0, len(values), slice_rows):
                    part = values[start : start + slice_rows].astype("float32")
                    yield pd.DataFrame(
                        {"file": name, "window_no": range(start, start + len(part)), "data": part.tolist()}
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(load, "file string, window_no bigint, data array<array<float>>")
    return truncate_channels(rows, channels)


def import_label_npy(spark: SparkSession, path: str) -> DataFrame:
    """Label files: rank 3 gives every step's label kinds, rank 1 one label per window.

    Rows ``file, window_no, labels`` with ``labels`` the kinds of the first step.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                values = np.load(BytesIO(content), allow_pickle=False)
                if values.ndim not in (1, 3):
                    raise ValueError(f"{name}: unsupported label shape {values.shape}")
                kinds = (values[:, 0, :] if values.ndim == 3 else values[:, None]).astype("int64")
                yield pd.DataFrame({"file": name, "window_no": range(len(kinds)), "labels": kinds.tolist()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(load, "file string, window_no bigint, labels array<bigint>")


def import_label_steps(spark: SparkSession, path: str, slice_rows: int = 256) -> DataFrame:
    """Label files with the label kinds of every step: rows ``file, window_no, step, labels``.

    A file of rank 1 has one label per window, which is that of step 0.  Take kinds out of ``labels`` as columns, and
    ``merge_window_labels`` gives each window its label.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                values = np.load(BytesIO(content), allow_pickle=False)
                if values.ndim not in (1, 3):
                    raise ValueError(f"{name}: unsupported label shape {values.shape}")
                values = values if values.ndim == 3 else values[:, None, None]
                steps, kinds = values.shape[1:]
                for start in range(0, len(values), slice_rows):
                    part = values[start : start + slice_rows].astype("int64")
                    yield pd.DataFrame({
                        "file": name, "window_no": np.repeat(np.arange(start, start + len(part)), steps),
                        "step": np.tile(np.arange(steps), len(part)), "labels": part.reshape(-1, kinds).tolist()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(load, "file string, window_no bigint, step bigint, labels array<bigint>")


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
