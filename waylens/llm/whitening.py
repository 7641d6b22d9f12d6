"""Embedding whitening over a tiled covariance.

Vectors are cut into blocks of rows and of columns. Blocks of columns that belong to one block of rows are shuffled to each
other, each pair of them is multiplied under its tile's key, and products are summed per tile. What reaches the driver is
the covariance (dimensions squared) and is decomposed there.

Values are integers, ``floor(64 * c) + 1000000``; all but rounding is exact. ``centre`` is the mean rounded to a whole number,
so centred values are small whole numbers, their products are exact in doubles (below 2^53), and what the rounding of the
mean left over is taken off in whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from waylens.llm.common import materialize

#: Dimensions of a tile's side, and rows of a block.
TILE, ROWS = 32, 2048
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this (an entry of 33 million) count as this.
MOST = float(1 << 31)
#: Eigenvalues below this share of the largest are rounding, not variance; such components have no whitened value.
NOISE = 1e-12
#: Values that a task of the first pass holds, over vectors of all lengths, before it passes sums on.
HELD = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` vectors, the sums of their whole-number values, eigenvalues falling, unit eigenvectors as
    columns, and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([_rounded(s, self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """``sums - n * centre``: at most half of ``n``."""
        return np.array([s - self.n * _rounded(s, self.n) for s in self.sums], np.int64)


def _rounded(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def _columns(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return vectors.select(quoted(id_col).alias("vec_id"), quoted(vec_col).cast("array<double>").alias("v"))


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch whose vector is complete and finite, their lengths, and the flat values of these as whole numbers."""
    column = batch.column(1)
    sizes = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    finite = np.isfinite(entries)
    row = np.repeat(np.arange(len(sizes)), sizes)
    spoilt = np.bincount(row[~finite], minlength=len(sizes)) > 0
    good = ~spoilt & (sizes > 0)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.clip(np.floor(entries[good[row]] * SCALE), -MOST, MOST)
    return np.flatnonzero(good), sizes[good], scaled.astype(np.int64) + OFFSET


def _matrix(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors of ``d`` entries, and their values as a matrix."""
    rows, sizes, flat = _whole(batch)
    fits = sizes == d
    return rows[fits], flat[np.repeat(fits, sizes)].reshape(-1, d)


def dimension_sums(vectors: DataFrame) -> DataFrame:
    """``length, dim, n, s`` over the vectors of each length that occurs; tasks add up before the shuffle."""
    result = StructType.fromDDL("length int, dim int, n bigint, s bigint")
    arrow = to_arrow_schema(result)

    def sums(batches):
        held: dict[int, list] = {}

        def rows():
            for length, (n, s) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(length, length, np.int32)), pa.array(np.arange(length, dtype=np.int32)), pa.array(np.full(length, n, np.int64)), pa.array(s)], schema=arrow)

        for batch in batches:
            _, sizes, flat = _whole(batch)
            at = np.repeat(sizes, sizes)
            for length in np.unique(sizes).tolist():
                own = flat[at == length].reshape(-1, length)
                n, s = held.get(length, (0, 0))
                held[length] = [n + len(own), s + own.sum(axis=0)]
            if sum(held) > HELD:
                yield from rows()
                held.clear()
        yield from rows()

    return vectors.mapInArrow(sums, result).groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def column_blocks(vectors: DataFrame, centre: np.ndarray, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """``block, col, width, cells``: the centred values of up to ``rows`` vectors (which are block ``block``) in the columns from
    ``col * tile`` on, as whole numbers of two bytes where they fit and of eight elsewhere."""
    d = len(centre)
    result = StructType.fromDDL("block bigint, col int, width int, cells binary")
    arrow = to_arrow_schema(result)

    def cut(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, x = _matrix(batch, d)
            for start in range(0, len(x), rows):
                y = x[start : start + rows] - centre
                out = []
                for col in range(-(-d // tile)):
                    own = y[:, col * tile : (col + 1) * tile]
                    kind = np.int16 if np.abs(own).max() < 1 << 15 else np.int64
                    out.append((block, col, own.shape[1], np.ascontiguousarray(own, kind).tobytes(), np.dtype(kind).itemsize))
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] * 16 + o[4] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], schema=arrow)

    return vectors.mapInArrow(cut, result)


def tile_products(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """``i, j, cell, s``: sums over all rows of the products of column ``i * tile + cell // tile`` and column
    ``j * tile + cell % tile``, for tiles ``i <= j``."""
    left = blocks.select("block", F.col("col").alias("i"), F.col("width").alias("wi"), F.col("cells").alias("a"))
    right = blocks.select("block", F.col("col").alias("j"), F.col("width").alias("wj"), F.col("cells").alias("b"))
    pairs = left.join(right, "block").where("i <= j").select("i", "j", "wi", "wj", "a", "b")
    result = StructType.fromDDL("i int, j int, cells array<double>")
    arrow = to_arrow_schema(result)

    def values(raw: bytes, width: int) -> np.ndarray:
        return np.frombuffer(raw, np.int16 if width % 16 == 2 else np.int64).reshape(-1, width // 16).astype(np.float64)

    def multiply(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, wi, wj, a, b in zip(*[c.to_pylist() for c in batch.columns[:4]], *batch.columns[4:], strict=True):
                product = np.zeros((tile, tile))
                product[: wi // 16, : wj // 16] = values(a.as_py(), wi).T @ values(b.as_py(), wj)
                held[i, j] = held.get((i, j), 0) + product
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([p.ravel() for p in held.values()], arrow[2].type)], schema=arrow)

    parts = pairs.mapInArrow(multiply, result).select("i", "j", F.posexplode("cells").alias("cell", "s"))
    return parts.groupBy("i", "j", "cell").agg(F.sum("s").alias("s"))


def assembled(tiles: pa.Table, n: int, rest: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The covariance from tile sums: products of centred values less those of what the centre's rounding left over."""
    d = len(rest)
    v = np.zeros((d, d))
    i, j, cell, s = (tiles.column(c).to_numpy() for c in ("i", "j", "cell", "s"))
    rows, columns = i * tile + cell // tile, j * tile + cell % tile
    inside = (rows < d) & (columns < d)
    for r, c, x in zip(rows[inside].tolist(), columns[inside].tolist(), s[inside].tolist(), strict=True):
        v[r, c] = v[c, r] = (n * int(x) - int(rest[r]) * int(rest[c])) / (n * n)
    return v


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", most: int = 32, tile: int = TILE, rows: int = ROWS) -> Whitening | None:
    """Fits on every vector that is whole and finite; None if there is none.

    Null vectors and those with null or non-finite entries are left out, and so are vectors of no entry or of another length
    than most have (of equal counts the longer length holds), for which no covariance is defined. Repeated rows count
    each time. Components without variance have none of the ``most`` places; other columns aren't read.
    """
    own = _columns(vectors, id_col, vec_col)
    totals = materialize(dimension_sums(own), "dimension-sums")
    usual = totals.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if usual is None:
        return None
    d, n = usual["length"], usual["n"]
    sums = tuple(r["s"] for r in totals.where(F.col("length") == d).orderBy("dim").collect())  # a row a dimension
    start = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    blocks = materialize(column_blocks(own, start.centre, tile, rows), "column-blocks")
    v = assembled(tile_products(blocks, tile).toArrow(), n, start.rest, tile)  # dimensions squared
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    kept = min(most, int((values > max(values[0], 0) * NOISE * d).sum()))
    return Whitening(n, sums, values[:kept].copy(), np.ascontiguousarray(vectors_[:, :kept]), float(np.trace(v)))


def _projected(x: np.ndarray, centre: np.ndarray, mean: np.ndarray, gains: np.ndarray) -> np.ndarray:
    return ((x - centre) - mean) @ gains


def identity_error(vectors: DataFrame, fit: Whitening, vec_col: str = "embedding", id_col: str = "vec_id") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all vectors; 0 without
    components. Tasks add up products and sums of whitened values, which are centred by the fit."""
    k, d = len(fit.values), len(fit.sums)
    if not k:
        return 0.0
    centre, mean, gains = fit.centre, fit.rest / fit.n, fit.vectors / np.sqrt(fit.values)
    result = StructType.fromDDL("cells array<double>")
    arrow = to_arrow_schema(result)

    def products(batches):
        held = np.zeros(k * k + k)
        for batch in batches:
            w = _projected(_matrix(batch, d)[1], centre, mean, gains)
            held += np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([held], arrow[0].type)], schema=arrow)

    parts = _columns(vectors, id_col, vec_col).mapInArrow(products, result).select(F.posexplode("cells").alias("cell", "s"))
    cells = parts.groupBy("cell").agg(F.sum("s").alias("s")).toArrow()  # components squared
    total = np.zeros(k * k + k)
    total[cells.column("cell").to_numpy()] = cells.column("s").to_numpy()
    total /= fit.n
    covariance = total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, fit: Whitening | None, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, deviation, whitened`` (an array, a value a component) of the vectors that the fit covers.

    ``deviation`` is the sum over dimensions of ``(n * x - sum)^2``, exact; null where it is beyond a long. Vectors that the
    fit leaves out have no row, repeated rows have a row each, null ids stay null.
    """
    own = _columns(vectors, id_col, vec_col)
    result = StructType([StructField("vec_id", own.schema["vec_id"].dataType), *StructType.fromDDL("deviation bigint, whitened array<double>").fields])
    if fit is None:
        return own.sparkSession.createDataFrame([], result)
    arrow = to_arrow_schema(result)
    n, d, k = fit.n, len(fit.sums), len(fit.values)
    centre, rest, gains = fit.centre, fit.rest, fit.vectors / np.sqrt(fit.values)
    mean = rest / n

    def deviations(y: np.ndarray) -> pa.Array:
        if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 31 and d * (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return pa.array(((n * y - rest) ** 2).sum(axis=1))
        exact = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())

    def rows(batches):
        for batch in batches:
            at, x = _matrix(batch, d)
            for start in range(0, len(x), ROWS):
                part = x[start : start + ROWS]
                w = _projected(part, centre, mean, gains)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[start : start + ROWS])), deviations(part - centre), lists], schema=arrow)

    return own.mapInArrow(rows, result)


def whitened_components(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", most: int = 32) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Empty tables, and tables whose vectors have no variance, give no rows; see ``fit_whitening`` and ``whiten`` for the rest.
    """
    fit = fit_whitening(vectors, vec_col, id_col, most)
    error = identity_error(vectors, fit, vec_col, id_col) if fit else 0.0
    shares = [float(e / fit.trace) for e in fit.values] if fit else []
    rows = whiten(vectors, fit, vec_col, id_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1) if shares else F.lit(None).cast("double")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
