"""Whitening of embeddings by shifted Cholesky QR.

Entries are taken to a grid of whole numbers, so that counts, sums and deviations are exact.  The fit list holds each
distinct vector once.  Its centred rows C are orthogonalised in passes over the cluster: a pass solves ``Q R = C`` row by
row with the factors found so far, sums ``Q'Q`` per task and then over tasks, and the driver takes the Cholesky factor of
that matrix of width x width numbers.  The first factors have a shift added to the diagonal, which keeps the factor
defined for nearly or fully dependent columns; later passes bring what the shift left uneven to unit length.  The
composed factor R has the singular values and right singular vectors of C: components and variances.  ``C'C`` is never
used for them directly, so components of small variance keep their digits.

Rows are left out if the vector is null, holds a null or non-finite entry or one beyond ``LARGEST`` on the grid, or is of
another length than most (of lengths equally common, the longest).  Null ids stay.  Repeated rows are all returned, and
count once in the fit.  Directions without variance are no components: a table of equal vectors has none and returns no
row, as an empty table does.  A deviation beyond 64 bits is null.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stridelake.llm.store import Kept

#: Entries on the grid are whole numbers that doubles hold exactly.
LARGEST = float(1 << 52)
#: Rows that are solved and multiplied at a time.
BLOCK = 8192
#: A pass more than three is needed for columns that are dependent, or nearly so, only.
MOST_PASSES = 8


class Whitening(NamedTuple):
    """``n`` distinct vectors with sums ``total``; ``axes`` (width x components) by falling ``variance``."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x - total / n`` in doubles, and ``n x - total`` exactly (where 64 bits hold it)."""
        whole, rest = self.total // self.n, self.total % self.n
        near = x - whole
        return near - rest / self.n, near * self.n - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[0] @ self.axes / np.sqrt(self.variance)


def grid_rows(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable rows in the batch, and their entries as ``floor(scale * entry)``."""
    column = column.cast(pa.large_list(pa.float64()))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.filter(fits)).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        cells = np.floor(values * scale)
        good = (np.abs(cells) <= LARGEST).all(1)
    return places[good], cells[good].astype(np.int64)


def packed(cells: np.ndarray) -> list[bytes]:
    """A row as four or eight bytes an entry, by what it needs; equal rows have equal bytes."""
    small = (np.abs(cells) < 1 << 31).all(1)
    return [row.astype("<i4" if s else "<i8").tobytes() for row, s in zip(cells, small.tolist())]


def unpacked(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Blocks of packed rows."""
    for start in range(0, len(column), BLOCK):
        block = column.slice(start, BLOCK)
        size = pc.binary_length(block).to_numpy()
        for entry, kind in ((4, "<i4"), (8, "<i8")):
            rows = block.filter(pa.array(size == entry * width))
            if len(rows):
                _, offsets, data = rows.cast(pa.large_binary()).buffers()
                edges = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
                yield np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(kind).reshape(-1, width).astype(np.int64)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` divided from the right by upper triangular ``factors``, one after the other, by substitution."""
    for factor in factors:
        out = np.empty_like(rows.T)
        for j in range(len(factor)):
            out[j] = (rows[:, j] - factor[:j, j] @ out[:j]) / factor[j, j]
        rows = out.T
    return rows


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and sums per dimension; whole numbers, so exact."""

    def add(batches):
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            for rows in unpacked(batch.column("cells"), width):
                n += len(rows)
                total += rows.sum(0)
        names = ["dimension", "total", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total), pa.array([n] * width, pa.int64())], names=names)

    found = fit.mapInArrow(add, "dimension int, total long, n long").groupBy("dimension").agg(F.sum("total"), F.sum("n")).collect()
    if not found:
        return 0, np.zeros(width, np.int64)
    return found[0][2], np.array([r[1] for r in sorted(found)], np.int64)


def _gram(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``Z'Z`` for the rows ``Z = of(rows)`` of ``size`` entries: one matrix per task, added up in Spark entry by entry."""
    at = np.triu_indices(size)

    def multiply(batches):
        found = np.zeros((size, size))
        for batch in batches:
            for rows in unpacked(batch.column("cells"), width):
                z = of(rows)
                found += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(found[at])], names=["i", "j", "v"])

    out = np.zeros((size, size))
    for i, j, v in fit.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular factor of ``gram + shift``; a shift that rounding defeats grows."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, 1e-15 * np.trace(gram))


def composed_factor(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int, width: int) -> np.ndarray:
    """R with ``C'C = R'R`` for the rows C behind ``gram_of(factors)``, the Gram matrix of C solved by ``factors``.

    The shift is 11 (m d + d (d + 1)) u times the squared norm, with m the rows that are summed in one product.
    """
    factors: list[np.ndarray] = []
    total = np.eye(width)
    while True:
        gram = gram_of(factors)
        lengths = np.linalg.eigvalsh(gram)
        # Even rows: each direction has unit length, or none at all if columns depend on each other.
        even = bool(factors) and bool(((lengths > 0.5) | (lengths < 1e-12)).all())
        if even or not np.trace(gram) or len(factors) == MOST_PASSES:
            values, vectors = np.linalg.eigh(gram)
            root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
            return np.linalg.qr(root, mode="r") @ total
        unit = np.finfo(float).eps / 2
        uneven = not factors or lengths[0] < 1e-8 * lengths[-1]
        shift = 11 * (min(n, BLOCK) * width + width * (width + 1)) * unit * lengths[-1] if uneven else 0.0
        factors.append(_factor(gram, shift))
        total = factors[-1] @ total


def _width(df: DataFrame, column: str) -> int | None:
    found = df.select(F.size(column).alias("width")).where("width > 0").groupBy("width").count()
    first = found.orderBy(F.desc("count"), F.desc("width")).first()
    return first and first[0]


def fit(df: DataFrame, column: str, components: int = 16, scale: int = 64, offset: int = 0) -> Whitening | None:
    """Whitening of the distinct grid vectors of ``df[column]``; None if there is no direction with variance.

    The driver holds matrices of width x width numbers; all rows stay in Spark.
    """
    width = _width(df, column)
    if width is None:
        return None

    def cells(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(grid_rows(batch.column(0), width, scale)[1]), pa.binary())], names=["cells"])

    kept = Kept(df.select(column).mapInArrow(cells, "cells binary").distinct(), "vectors")
    try:
        n, total = _sums(kept.df, width)
        if not n:
            return None
        centre = Whitening(n, total, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)
        r = composed_factor(lambda factors: _gram(kept.df, width, lambda x: solved(centre.centred(x)[0], factors), width), n, width)
        _, length, axes = np.linalg.svd(r)
        count = min(components, int((length > length[0] * 8 * width * np.finfo(float).eps).sum()))
        if not count:
            return None
        axes = axes[:count].T
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(count)])
        variance = length**2 / n
        found = Whitening(n, total + n * offset, axes, variance[:count], variance[:count] / variance.sum(), 0.0)
        at_grid = found._replace(total=total)

        def with_one(x):
            return np.hstack([at_grid.whitened(x), np.ones((len(x), 1))])

        moments = _gram(kept.df, width, with_one, count + 1) / n
        covariance = moments[:count, :count] - np.outer(moments[:count, count], moments[:count, count])
        return found._replace(identity_error=float(np.abs(covariance - np.eye(count)).max()))
    finally:
        kept.release()


def whitened(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 16, scale: int = 64, offset: int = 0) -> DataFrame:
    """Per usable row and component: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    Grid entries are ``floor(scale * entry) + offset``; ``deviation`` is the sum of ``(n x - S)^2`` over dimensions.
    """
    model = fit(df, column, components, scale, offset)
    id_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    width, count = model.axes.shape

    def project(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                places, cells = grid_rows(part.column(1), width, scale)
                near, exact = model.centred(cells + offset)
                size = (near * model.n) ** 2
                held = size.sum(1) < 9.2e18
                with np.errstate(over="ignore"):
                    deviation = pa.array((exact * exact).sum(1), mask=~held)
                rows = np.repeat(np.arange(len(places)), count)
                fixed = len(places) * count
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(places[rows])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(places))),
                     pa.array(np.full(fixed, model.n, np.int64)), deviation.take(pa.array(rows)), pa.array((near @ model.axes / np.sqrt(model.variance)).ravel()),
                     pa.array(np.tile(model.explained, len(places))), pa.array(np.full(fixed, model.identity_error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(key, column).mapInArrow(project, schema)
