"""The catalog of window sets: rate, length, channels, and names of their labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("activity", "user", "position", "model")
ENTRY = (
    "sr int, seq_len int, dimension int, size bigint, "
    + ", ".join(f"{k}_label_index int, {k}_label_size int, {k}_label array<string>" for k in KINDS)
)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per set and label kind: ``dataset, version, rate_hz, window, dimension, size, kind, ...``.

    The file is one JSON object of ``name_version`` entries; ``version`` is what
    follows the name and ends in ``rate_window``, so names may hold underscores.
    """
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string, struct<{_struct(ENTRY)}>>")).alias("key", "e"))
    kinds = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"), F.col(f"e.{k}_label_index").alias("label_index"),
                F.col(f"e.{k}_label_size").alias("label_size"), F.col(f"e.{k}_label").alias("names"),
            )
            for k in KINDS
        ]
    )
    return entries.select(
        F.regexp_extract("key", "^(.+?)_([0-9]+_[0-9]+)$", 1).alias("dataset"), F.regexp_extract("key", "^(.+?)_([0-9]+_[0-9]+)$", 2).alias("version"),
        F.col("e.sr").alias("rate_hz"), F.col("e.seq_len").alias("window"), F.col("e.dimension").alias("dimension"),
        F.col("e.size").alias("size"), F.explode(kinds).alias("k"),
    ).select("dataset", "version", "rate_hz", "window", "dimension", "size", "k.*").filter("label_index is not null")


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (field.split(" ", 1) for field in ddl.split(", ")))


@dataclass(frozen=True)
class LabelKind:
    index: int
    count: int
    names: Sequence[str] | None


@dataclass(frozen=True)
class CatalogEntry:
    dataset: str
    version: str
    rate_hz: int
    window: int
    dimension: int
    size: int
    kinds: dict[str, LabelKind]

    def kind(self, name: str) -> LabelKind:
        """A label kind by name; a kind the set does not have is an error."""
        if name not in self.kinds:
            raise ValueError(f"{self.dataset} has no {name} label; it has {sorted(self.kinds)}")
        return self.kinds[name]


def catalog_entry(catalog: DataFrame, dataset: str, version: str) -> CatalogEntry:
    """The entry of one window set; an unknown name is an error."""
    rows = catalog.filter((F.col("dataset") == dataset) & (F.col("version") == version)).limit(len(KINDS)).collect()
    if not rows:
        raise ValueError(f"no window set {dataset}_{version} in the catalog")
    first = rows[0]
    return CatalogEntry(
        dataset, version, first["rate_hz"], first["window"], first["dimension"], first["size"],
        {r["kind"]: LabelKind(r["label_index"], r["label_size"], r["names"]) for r in rows},
    )
