"""Tables that later steps read again, in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stridelake.sources.folders import shared_folder


class Kept:
    """A written table: ``df`` reads it, ``release`` deletes it once no later step needs it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def release(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with zstandard to a new path in the shared folder and read back; it stays for the result's readers."""
    return Kept(df, name).df


def bytes_of(column: pa.ChunkedArray) -> Iterator[memoryview]:
    """Values of a binary column, one at a time and without copies."""
    return (memoryview(value.as_buffer()) for value in column)
