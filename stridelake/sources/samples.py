"""Delimited sensor and label files, and the flat sample sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.stream import require_columns

MALFORMED = "_malformed"

# Column layouts of the sources.
LONG_LOG_COLUMNS = [
    "Time", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "ori_w", "ori_x", "ori_y", "ori_z",
    "gra_x", "gra_y", "gra_z", "lin_x", "lin_y", "lin_z", "pre", "alt", "temp",
]
LONG_LOG_KEPT = [
    "Time", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "gra_x", "gra_y", "gra_z",
]
LONG_LOG_LABEL_COLUMNS = [
    "Time", "Coarse_label", "Fine_label", "Road_label", "Traffic_label", "Tunnels_label", "Social_label", "Food_label",
]
PHONE_SCHEMA = (
    "Index bigint, Arrival_Time bigint, Creation_Time bigint, x double, y double, z double, "
    "User string, Model string, Device string, gt string"
)
DUAL_LOG_COLUMNS = [
    "time_ms", "left_accel_x", "left_accel_y", "left_accel_z", "left_gyro_x", "left_gyro_y", "left_gyro_z",
    "right_accel_x", "right_accel_y", "right_accel_z", "right_gyro_x", "right_gyro_y", "right_gyro_z",
]


def doubles(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType()) for c in columns])


def _as_struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_samples(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, sep: str = ",", header: bool = True,
    columns: Sequence[str] | None = None, path_keys: Mapping[str, tuple[str, str]] | None = None,
    drop_malformed: bool = False,
) -> DataFrame:
    """Rows of delimited files under a stated schema, never inferred.

    ``header`` skips the first line of each file.  Every line is a row.  Where a
    chosen column's value does not fit its type (a second header line, noise) it is
    null and ``_malformed`` holds the chosen columns' text; columns that are not
    chosen are not looked at.  ``drop_malformed`` leaves such rows, and the column,
    out; :func:`count_malformed` says how many they are.  Missing fields at the end
    are null, surplus ones are ignored.
    ``path_keys`` adds columns taken from the file's path: ``{"user": (regex, "int")}``
    casts the regex's first group.
    """
    fields = _as_struct(schema)
    chosen = list(columns) if columns is not None else fields.names
    missing = [c for c in chosen if c not in fields.names]
    if missing:
        raise ValueError(f"columns {missing} are not in the schema {fields.names}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in fields.names])
    raw = spark.read.csv(
        list(path) if not isinstance(path, str) else path, schema=texts, sep=sep, header=header, mode="PERMISSIVE",
        enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = F.lit(False)
    for name in chosen:
        bad = bad | (F.col(name).isNotNull() & typed[name].isNull())
    keys = [
        F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("")).try_cast(kind).alias(name)
        for name, (pattern, kind) in (path_keys or {}).items()
    ]
    values = [typed[c].alias(c) for c in chosen]
    if drop_malformed:
        return raw.filter(~bad).select(*values, *keys)
    return raw.select(*values, *keys, F.when(bad, F.concat_ws(sep, *chosen)).alias(MALFORMED))


def count_malformed(df: DataFrame) -> DataFrame:
    """``n_rows, n_malformed`` of what :func:`read_samples` gave without dropping."""
    require_columns(df, [MALFORMED])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(MALFORMED).alias("n_malformed"))


def with_path_keys(df: DataFrame, path_keys: Mapping[str, tuple[str, str]], path: str = "file_path") -> DataFrame:
    """Columns from a path column: the first group of each regex, cast; no match is null."""
    require_columns(df, [path])
    return df.withColumns(
        {
            name: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).try_cast(kind)
            for name, (pattern, kind) in path_keys.items()
        }
    )


def read_labels(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, columns: Sequence[str], sep: str = " ",
    header: bool = False, path_keys: Mapping[str, tuple[str, str]] | None = None, drop_malformed: bool = False,
) -> DataFrame:
    """A label stream or segment list: a few columns of a delimited file."""
    return read_samples(spark, path, schema, sep, header, columns, path_keys, drop_malformed)


def write_samples_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Flat files with a header line each, written by all tasks."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)
