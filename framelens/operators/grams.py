"""Products of features summed over all frames: correlations, covariances times vectors, wide principal components.

Tasks multiply blocks of frames and hand on tiles of at most ``TILE`` by ``TILE`` sums, one binary
value each. Tiles are dealt by their place and added up one after the other, so a task holds
one tile however many tasks there were; nothing as wide as features by features lies anywhere
in one piece. Values are centred on the features' means before they are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.features import to_long

TILE = 512
#: Rows that are multiplied at once.
ROWS = 2048


def rows_of(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix of doubles, without a Python object per row; null becomes NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def means_of(df: DataFrame, features: str) -> np.ndarray:
    """The mean of every feature, 0 where it has no value; a number for each feature."""
    rows = to_long(df, features).groupBy("pos").agg(F.avg("x").alias("m")).collect()
    out = np.zeros(1 + max((r["pos"] for r in rows), default=-1))
    for r in rows:
        out[r["pos"]] = r["m"] if r["m"] is not None else 0.0
    return out


def summed_tiles(partial: DataFrame) -> DataFrame:
    """i, j, tile (doubles) of rows i, j, tile: the sums of the tiles of each place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "tile"])

        for batch in batches:
            for i, j, tile in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["tile"], strict=True):
                own = np.frombuffer(tile.as_buffer(), float)
                if (i, j) == place:
                    total += own
                else:
                    if place is not None:
                        yield done()
                    place, total = (i, j), own.copy()
        if place is not None:
            yield done()

    return partial.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, "i int, j int, tile binary")


def tiles_of(df: DataFrame, columns: list[str], products: Callable[..., dict[tuple[int, int], np.ndarray]]) -> DataFrame:
    """i, j, tile: what products gives for blocks of rows of columns, summed over all rows."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for place, tile in products(*[part.column(k) for k in range(len(columns))]).items():
                    if place in sums:
                        sums[place] += tile
                    else:
                        sums[place] = tile
        for (i, j), tile in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([tile.tobytes()], pa.binary())], ["i", "j", "tile"])

    return summed_tiles(df.select(*columns).mapInArrow(multiply, "i int, j int, tile binary"))


def correlations(df: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """i, j, r: Pearson correlations of the features left with the features right (or among themselves, i < j).

    Each pair is taken over the rows in which both have a value; undefined ones are 0.
    """
    df = df.where(F.col(left).isNotNull() & F.col(right or left).isNotNull())
    shift_a, shift_b = means_of(df, left), means_of(df, right or left)
    p, q = len(shift_a), len(shift_b)
    blocks = lambda n: [(k, slice(k * TILE, min((k + 1) * TILE, n))) for k in range(-(-n // TILE))]

    def products(first: pa.Array, second: pa.Array) -> dict[tuple[int, int], np.ndarray]:
        a = rows_of(first) - shift_a
        b = rows_of(second) - shift_b if right else a
        full = not (np.isnan(a).any() or np.isnan(b).any())
        has_a, has_b = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        out = {}
        for i, rows in blocks(p):
            for j, cols in blocks(q):
                if not right and j < i:
                    continue
                x, y, u, v = a[:, rows], b[:, cols], has_a[:, rows], has_b[:, cols]
                if full:  # sums over the rows of a pair are those over all rows
                    wide = lambda s, along: np.broadcast_to(s[:, None] if along else s, (x.shape[1], y.shape[1]))  # noqa: B023, E731
                    out[i, j] = np.stack([wide(np.full(y.shape[1], float(len(x))), 0), wide(x.sum(0), 1), wide(y.sum(0), 0), wide((x * x).sum(0), 1), wide((y * y).sum(0), 0), x.T @ y])
                else:
                    out[i, j] = np.stack([u.T @ v, x.T @ v, u.T @ y, (x * x).T @ v, u.T @ (y * y), x.T @ y])
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tile in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["tile"], strict=True):
                rows, cols = dict(blocks(p))[i], dict(blocks(q))[j]
                n, sa, sb, aa, bb, ab = np.frombuffer(tile.as_buffer(), float).reshape(6, rows.stop - rows.start, cols.stop - cols.start)
                with np.errstate(invalid="ignore", divide="ignore"):
                    va, vb, both = aa - sa * sa / n, bb - sb * sb / n, ab - sa * sb / n
                    flat = (va <= 1e-14 * aa) | (vb <= 1e-14 * bb) | (n < 2)
                    r = np.where(flat, 0.0, np.clip(np.nan_to_num(both / np.sqrt(va * vb)), -1, 1))
                at = np.indices(r.shape)
                own_i, own_j = at[0].ravel() + rows.start, at[1].ravel() + cols.start
                kept = slice(None) if right else own_i < own_j
                yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (own_i.astype(np.int32), own_j.astype(np.int32), r.ravel())], ["i", "j", "r"])

    tiles = tiles_of(df, [left, right or left], products) if right else tiles_of(df.select(left, F.col(left).alias("_same")), [left, "_same"], products)
    return tiles.mapInArrow(finish, "i int, j int, r double")


def covariance_times(df: DataFrame, features: str, shift: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over all rows of x (x . basis), with x centred by shift: as many numbers as basis has."""
    p, k = basis.shape
    shared = df.sparkSession.sparkContext.broadcast((shift, basis))  # features times a block of vectors

    def products(column: pa.Array) -> dict[tuple[int, int], np.ndarray]:
        mean, vectors = shared.value
        x = np.nan_to_num(rows_of(column) - mean)
        out = x.T @ (x @ vectors)
        return {(i, 0): out[i * TILE : (i + 1) * TILE] for i in range(-(-p // TILE))}

    rows = sorted(tiles_of(df, [features], products).collect(), key=lambda r: r["i"])
    return np.concatenate([np.frombuffer(r["tile"], float).reshape(-1, k) for r in rows]) if rows else np.zeros((p, k))


def leading_components(df: DataFrame, features: str = "features", k: int = 2, share: float | None = None, block: int = 8, tolerance: float = 1e-9, passes: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(values, vectors, means, total variance): the k leading eigenpairs of the covariance, or as many as hold share of the total.

    Block Krylov iteration from random vectors: a pass over the rows multiplies the newest block of
    a growing orthonormal basis, and the covariance restricted to the basis gives the pairs. It
    ends when their residuals are below tolerance times the largest value, or the basis spans
    all features. The driver holds features times basis numbers; the covariance is never formed.
    """
    df = df.where(F.col(features).isNotNull()).select(features)
    stats = to_long(df, features).groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()
    if not stats:
        raise ValueError("no rows")
    p, rows = 1 + max(r["pos"] for r in stats), df.count()
    means, total = np.zeros(p), 0.0
    for r in stats:
        means[r["pos"]] = r["m"] or 0.0
        total += (r["v"] or 0.0) * r["n"] / max(rows - 1, 1)
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    new = np.random.default_rng(seed).normal(size=(p, min(p, max(block, 1 if share is not None else k))))
    for _ in range(passes):
        for _ in range(2):  # twice, so that rounding leaves nothing of the old vectors
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        new = new[:, : p - basis.shape[1]]
        basis, image = np.hstack([basis, new]), np.hstack([image, covariance_times(df, features, means, new) / max(rows - 1, 1)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        running = np.cumsum(values)
        wanted = min(k, p) if share is None else int(np.searchsorted(running, share * total * (1 - 1e-12))) + 1
        if wanted <= len(values):
            vectors = basis @ turn[:, :wanted]
            residuals = np.linalg.norm(image @ turn[:, :wanted] - vectors * values[:wanted], axis=0)
            if basis.shape[1] >= p or (residuals <= tolerance * max(values[0], 1e-300)).all():
                return values[:wanted], vectors, means, total
        elif basis.shape[1] >= p:
            return values, basis @ turn, means, total
        new = image[:, -new.shape[1] :]
    raise RuntimeError(f"components did not settle in {passes} passes")
