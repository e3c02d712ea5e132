"""User functions on batches of windows, carried by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPARK_TYPES = {"float32": T.FloatType(), "float64": T.DoubleType()}


def _tensor(column: pa.Array, dtype: str) -> np.ndarray:
    """A list-of-lists column, all windows of one shape, as (B, W, F); nulls and other shapes are errors."""
    rows = column.flatten()
    values = rows.flatten()
    if column.null_count or rows.null_count or values.null_count:
        raise ValueError("a window, a step or a value is null; remove such windows before scoring")
    steps, widths = np.unique(column.value_lengths()), np.unique(rows.value_lengths())
    if len(steps) > 1 or len(widths) > 1:
        raise ValueError(f"windows of one batch differ in shape: {steps.tolist()} steps, {widths.tolist()} channels")
    flat = values.to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), *(int(n[0]) if len(n) else 0 for n in (steps, widths)))


def _lists(values: np.ndarray, dtype: str) -> pa.Array:
    array = pa.array(np.ascontiguousarray(values, dtype=dtype).reshape(-1))
    for size in reversed(values.shape[1:]):
        offsets = np.arange(0, len(array) + 1, size, dtype="int32")
        array = pa.ListArray.from_arrays(pa.array(offsets), array)
    return array


def score(
    df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], data: str = "data", out: str = "scores", rank: int = 1,
    batch: int = 128, dtype: str = "float32",
) -> DataFrame:
    """Replace the windows of ``data`` with ``fn`` of them, ``batch`` windows at a time.

    ``fn`` maps (B, W, F) to (B, n) for ``rank=1`` or (B, W, n) for ``rank=2``, in
    ``dtype``.  All windows have one shape; a null or ragged one ends the query
    (see ``validate_windows``).  No shuffle; a task holds one batch.
    """
    names = [c for c in df.columns if c != data]
    kind = T.ArrayType(SPARK_TYPES[dtype], False)
    for _ in range(rank - 1):
        kind = T.ArrayType(kind, False)
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                result = _lists(fn(_tensor(part.column(data), dtype)), dtype)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], result], [*names, out])

    return df.select(*names, data).mapInArrow(run, schema)
