"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors lie on an integer grid: an entry c is floor(scale * c) + offset, so that counts, sums
and deviations are exact. The fit list holds each distinct vector once; its rows are written
as packed blocks and read in turn for

* ``X v``: a block of right vectors is multiplied, made orthogonal to all earlier left
  vectors and to itself;
* ``X' u``: the left vectors so found are multiplied back, orthogonalised once more in the
  same reading, and what is left beside all earlier right vectors is the next block.

Left vectors are as long as the fit list, so they are never stored: each is X times a short
vector of coefficients and is made anew in the task that reads the rows. What leaves a task
is a few sums of (dimensions x block) size. The driver holds vectors of that size only, and
the singular values and right vectors of the small (block) bidiagonal matrix give the
components. ``block=1`` is the recurrence of single vectors; wider blocks read the rows
fewer times and find deviations that occur up to that often.

Rows are centred before they are multiplied: (n * x - S) is exact in integers.

Defined results: rows whose vector is null or holds null or non-finite entries are left out;
shorter vectors are filled up with zeros; entries whose grid value has no 64-bit integer get
the nearest one; repeated and null IDs are rows like others. A component whose share of the
variance is at most ``RANK_SHARE`` counts as absent, so that constant tables and single rows
have none and empty tables give no rows. A deviation beyond 64 bits is null. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import map_texts, packed, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BLOCK = 8
RANK_SHARE = 1e-11
#: Parts of a norm below which a direction is rounding.
_NOISE = 1e-14
#: Share of all variance below which a left vector can't be told from rounding.
_LOST = 1e-13
#: Error of a component, relative to the largest deviation, at which the recurrence ends.
_CONVERGED = 1e-14
_LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What turns a vector on the grid into uncorrelated numbers of variance 1.

    ``sums`` are the exact sums per dimension without the offset; ``components`` has a unit
    vector in each column.
    """

    rows: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    scale: int
    offset: int


def on_grid(
    df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """``id_col, x`` (array<bigint>) of rows with a vector of finite entries."""
    entries = F.col("x")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    highest = F.lit(_LONG - 1 - offset)
    return (
        df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("x"))
        .filter(entries.isNotNull() & fine)
        .withColumn("x", F.transform("x", lambda c: F.least(F.floor(c * scale), highest) + offset))
    )


def _matrix(lists: pa.ListArray, dims: int, offset: int) -> np.ndarray:
    """Grid vectors without their offset, filled up to ``dims``."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - offset
    if (lengths == dims).all():
        return flat.reshape(len(lists), dims)
    whole = np.zeros((len(lists), dims), np.int64)
    whole[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return whole


def _pack(dims: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims, offset)
            small = not len(x) or np.abs(x.astype(np.float64)).max() < 2**15
            yield pa.RecordBatch.from_arrays(
                [pa.array([small]), pa.array([packed(x.astype("<i2" if small else "<i8"))],
                                             pa.binary())],
                names=["small", "x"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for small, data in zip(batch.column(0), batch.column(1)):
            kind = "<i2" if small.as_py() else "<i8"
            yield np.frombuffer(data.as_buffer(), kind).astype(np.int64).reshape(-1, dims)


def _exact(x: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S in 64-bit integers, or in Python's where those are too short."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)), *map(abs, sums), 1)
    if rows * top < _LONG // 4:
        return x * rows - np.array(sums, np.int64)
    return x.astype(object) * rows - np.array(sums, object)


def _centred(x: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_exact(x, rows, sums) / rows).astype(np.float64)


def _summed(blocks: DataFrame, dims: int, size: int, values: Callable) -> np.ndarray:
    """Sums over all blocks of the ``size`` numbers that ``values`` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _blocks(batches, dims):
            total += values(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"]
        )

    found = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")
    )
    result = np.zeros(size)
    for row in found.collect():
        result[row["at"]] = row["value"]
    return result


def _sums(blocks: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums per dimension; place ``dims`` counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for x in _blocks(batches, dims):
            wide = x if np.abs(x.astype(np.float64)).max(initial=0) < 2**40 else x.astype(object)
            parts = [*wide.sum(axis=0).tolist(), len(x)]
            total = [a + b for a, b in zip(total, parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims + 1), pa.int32()), pa.array([str(v) for v in total])],
            names=["at", "value"],
        )

    added = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    found = blocks.mapInArrow(run, "at int, value string").groupBy("at").agg(added)
    total = {row["at"]: int(row["value"]) for row in found.collect()}
    return total.get(dims, 0), tuple(total.get(i, 0) for i in range(dims))


def _orthogonal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vectors = vectors - against @ (against.T @ vectors)
    return vectors


def _right_block(
    residual: np.ndarray, right: np.ndarray, width: int, norm: float, rng: np.random.Generator
) -> np.ndarray:
    """Orthonormal vectors beside all earlier ones: of the residual, then random ones."""
    width = min(width, right.shape[0] - right.shape[1])
    vectors, sizes, _ = np.linalg.svd(_orthogonal(residual, right), full_matrices=False)
    block = vectors[:, sizes > _NOISE * norm][:, :width]
    while block.shape[1] < width:
        known = np.hstack([right, block])
        fresh = _orthogonal(rng.standard_normal((right.shape[0], width - block.shape[1])), known)
        block = np.hstack([block, np.linalg.qr(fresh)[0]])
    # Once more, as singular vectors of a small residual lean on the earlier ones.
    return np.linalg.qr(_orthogonal(block, right))[0]


def bidiagonalise(
    product: Callable, dims: int, wanted: int, width: int, squares: float
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of X, largest first.

    ``product(a, w)`` gives (U'Y, Y'Y, X'Y) for Y = X a and U = X w; ``squares`` is the sum
    of all squared entries of X.
    """
    rng = np.random.default_rng(7)
    norm = squares**0.5
    right, left = np.zeros((dims, 0)), np.zeros((dims, 0))  # V, and W with U = X W
    back = np.zeros((dims, 0))  # X'U
    middle = np.zeros((0, 0))  # U'XV: (block) upper bidiagonal
    block = _right_block(np.zeros((dims, 0)), right, width, norm, rng)
    while block.shape[1]:
        # X v: beside the earlier left vectors, and orthogonal in itself.
        shared, gram, _ = product(block, left)
        values, vectors = np.linalg.eigh(gram - shared.T @ shared)
        found = values > _LOST * squares
        lengths = np.sqrt(values[found])
        coefficients = (block - left @ shared) @ vectors[:, found] / lengths
        factor = lengths[:, None] * vectors[:, found].T
        # X'u, with the second orthogonalisation.
        again, gram, returned = product(coefficients, left)
        corner = np.linalg.cholesky(gram - again.T @ again).T
        inverse = np.linalg.inv(corner)
        coefficients = (coefficients - left @ again) @ inverse
        returned = (returned - back @ again) @ inverse
        column = np.vstack([shared + again @ factor, corner @ factor])
        middle = np.hstack(
            [np.vstack([middle, np.zeros((len(corner), middle.shape[1]))]), column]
        )
        right = np.hstack([right, block])
        left, back = np.hstack([left, coefficients]), np.hstack([back, returned])
        residual = _orthogonal(returned, right)
        sides, values, _ = np.linalg.svd(middle, full_matrices=False)
        error = residual @ sides[len(middle) - len(corner):, :wanted]
        if len(corner) and middle.shape[1] >= 2 * wanted and (
            np.linalg.norm(error, axis=0).max(initial=0.0) <= _CONVERGED * norm
        ):
            break
        if not len(corner) and block.shape[1] == width:
            # Random directions beside the found ones meet no variance: there is none left.
            break
        block = _right_block(residual, right, width, norm, rng)
    _, values, turned = np.linalg.svd(middle, full_matrices=False)
    return right @ turned.T, values


def fit_whitening(
    vectors: DataFrame,
    vector_col: str = "x",
    components: int = COMPONENTS,
    block: int = BLOCK,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> Whitening:
    """Components of grid vectors (of ``on_grid``), each distinct vector counted once."""
    dims = vectors.agg(F.max(F.size(vector_col))).head()[0] or 0
    if not dims:
        empty = np.zeros((0, 0))
        return Whitening(0, (), empty, np.zeros(0), 0.0, 0.0, scale, offset)
    full = F.concat(
        F.col(vector_col), F.array_repeat(F.lit(offset).cast("bigint"), dims - F.size(vector_col))
    )
    fit = map_texts(
        vectors.select(full.alias("x")).distinct(), _pack(dims, offset), "small boolean, x binary"
    )
    blocks = written(fit)
    rows, sums = _sums(blocks, dims)
    nothing = Whitening(rows, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0, scale, offset)
    if rows < 2:
        return nothing
    squares = float(
        _summed(blocks, dims, 1, lambda x: np.square(_centred(x, rows, sums)).sum())[0]
    )
    if squares == 0.0:
        return nothing

    def product(a: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shapes = [(w.shape[1], a.shape[1]), (a.shape[1], a.shape[1]), (dims, a.shape[1])]
        ends = np.cumsum([m * n for m, n in shapes])

        def values(x: np.ndarray) -> np.ndarray:
            centred = _centred(x, rows, sums)
            y = centred @ a
            parts = ((centred @ w).T @ y, y.T @ y, centred.T @ y)
            return np.concatenate([p.ravel() for p in parts])

        if not a.shape[1]:
            return tuple(np.zeros(s) for s in shapes)
        total = _summed(blocks, dims, int(ends[-1]), values)
        return tuple(p.reshape(s) for p, s in zip(np.split(total, ends[:-1]), shapes))

    found, deviations = bidiagonalise(product, dims, components, block, squares)
    kept = np.flatnonzero(np.square(deviations) > RANK_SHARE * squares)[:components]
    found, variances = found[:, kept], np.square(deviations[kept]) / rows
    peaks = found[np.abs(found).argmax(axis=0), np.arange(len(kept))]
    found = found * np.sign(peaks)
    turn, size = found / np.sqrt(variances), len(kept)

    def white(x: np.ndarray) -> np.ndarray:
        y = _centred(x, rows, sums) @ turn
        return (y.T @ y).ravel()

    covariance = _summed(blocks, dims, size * size, white).reshape(size, size) / rows
    error = float(np.abs(covariance - np.eye(size)).max())
    return Whitening(rows, sums, found, variances, squares / rows, error, scale, offset)


def whiten(
    vectors: DataFrame, model: Whitening, id_col: str, vector_col: str = "x"
) -> DataFrame:
    """``id_col, deviation, whitened`` (array<double>, one entry per component) of every row."""
    dims, turn = len(model.sums), model.components / np.sqrt(model.variances)
    rows, sums, offset = model.rows, model.sums, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims, offset)
            exact = _exact(x, rows, sums)
            peak = np.abs(exact.astype(np.float64)).max(initial=0.0)
            wide = exact if peak**2 * max(dims, 1) < _LONG / 4 else exact.astype(object)
            squares = [int(v) for v in (wide * wide).sum(axis=1)]
            white = (exact / rows).astype(np.float64) @ turn
            starts = np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([v if v < _LONG else None for v in squares], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(white.ravel())),
                ],
                names=[id_col, "deviation", "whitened"],
            )

    kind = vectors.schema[id_col].dataType.simpleString()
    return map_texts(
        vectors.select(id_col, vector_col), run,
        f"`{id_col}` {kind}, deviation bigint, whitened array<double>",
    )


def whitened_rows(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options
) -> DataFrame:
    """One row per vector and component: ``id_col, component, n, deviation, whitened,
    explained, identity_error``."""
    vectors = on_grid(df, id_col, vector_col)
    model = fit_whitening(vectors, **options)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    rows = whiten(vectors, model, id_col).select(
        id_col, "deviation", F.posexplode("whitened").alias("place", "whitened")
    )
    return rows.select(
        id_col,
        (F.col("place") + 1).alias("component"),
        F.lit(model.rows).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares.cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
