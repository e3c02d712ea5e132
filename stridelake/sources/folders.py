"""Where jobs put tables that they read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A new path in the folder that the cluster shares, named by ``spark.checkpoint.dir``.

    A machine's own temporary folder serves local sessions without the setting only.
    """
    base = spark.conf.get(SETTING, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stridelake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A table in the shared folder: ``df`` reads it, ``release`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str = "stage"):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def release(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to a shared folder and read back.

    For a result that several later steps read: they scan columns of a table that
    outlives executors instead of repeating the work behind it.  The table stays;
    the folder's own retention removes it.
    """
    return Stored(df, name).df
