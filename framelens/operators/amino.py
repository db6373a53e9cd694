"""Clustering of features by mutual information.

The distance of two features is 1 - I/H of their joint density, estimated on a grid from all
frames (``sample_rows`` of them where a caller asks for it), each with its weight if there are
any. With the radial Epanechnikov kernel tasks add the kernels of their frames to the grids of a
group of pairs, and the grids are summed by pair and cell. The Gaussian kernel is a product of
one factor for each feature, so the grids of all pairs are the tiles of one product of matrices.
The matrix of distances between candidates comes to the driver for k-medoids.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions.features import to_long
from framelens.operators.grams import TILE, rows_of, tiles_of
from framelens.operators.selection import drawn

#: Grid points where the number of frames decides, at most.
MAX_BINS = 50
ROUNDS = 100
#: Grid cells that a task adds to, at most.
CELLS = 1 << 20


def normalised(values: np.ndarray) -> np.ndarray:
    """Rows over their deviation (of the population); constant rows become 0."""
    spread = values.std(1, keepdims=True)
    return np.where(spread > 1e-12, values / np.where(spread > 1e-12, spread, 1.0), 0.0)


def normalised_frames(df: DataFrame, features: str = "features") -> DataFrame:
    """df with every feature over its deviation (of the population); constant features become 0."""
    spread = to_long(df, features).groupBy("pos").agg(F.stddev_pop("x").alias("s"))
    # One row, as wide as a frame.
    scales = spread.agg(F.map_from_entries(F.collect_list(F.struct("pos", F.when(F.col("s") > 1e-12, F.col("s")).alias("s")))).alias("_scales"))
    over = lambda x, i: F.when(x.isNotNull(), F.coalesce(x.cast("double") / F.element_at("_scales", i), F.lit(0.0)))
    return df.crossJoin(F.broadcast(scales)).withColumn(features, F.transform(features, over)).drop("_scales")


def bandwidth(n: float, kernel: str = "epanechnikov", weights: np.ndarray | None = None) -> float:
    if weights is not None:
        n = weights.sum() ** 2 / (weights**2).sum()
    return (2.2 if kernel == "epanechnikov" else 1.0) * n ** (-1 / 6)


def joint_density(a: np.ndarray, b: np.ndarray, bins: int, width: float) -> np.ndarray:
    """Density of two trajectories on the grid of their ranges, adding up to 1."""
    ga, gb = np.linspace(a.min(), a.max(), bins), np.linspace(b.min(), b.max(), bins)
    out = np.zeros((bins, bins))
    for start in range(0, len(a), 256):
        da = ((ga[:, None] - a[None, start : start + 256]) / width) ** 2
        db = ((gb[:, None] - b[None, start : start + 256]) / width) ** 2
        out += np.maximum(0.0, 1 - (da[:, None, :] + db[None, :, :])).sum(2)
    total = out.sum()
    return out / total if total > 0 else np.full((bins, bins), 1 / bins**2)


def information_distance(p: np.ndarray) -> float:
    """1 - I/H of a joint density, at least 0."""
    on = p > 0
    h = -(p[on] * np.log(p[on])).sum()
    if h <= 1e-12:
        return 0.0
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float(max(0.0, 1 - (p[on] * np.log(p[on] / outer[on])).sum() / h))


def sampled_trajectories(df: DataFrame, features: str = "features", rows: int | None = None, seed: int = 42) -> np.ndarray:
    """Features by frames, normalised, on the driver: for tables that fit there."""
    x = drawn(df.select(F.col(features).cast("array<double>").alias("x")), rows, "x", seed=seed).toPandas()["x"]
    return normalised(np.nan_to_num(np.stack(x.to_numpy()).T)) if len(x) else np.zeros((0, 0))


def pair_distances(spark: SparkSession, trajectories: np.ndarray, bins: int | None = 20) -> DataFrame:
    """i, j, distance for all i <= j of trajectories on the driver."""
    count, n = trajectories.shape
    grid = min(bins or int(np.ceil(np.sqrt(n))), MAX_BINS)
    width = bandwidth(n)
    shared = spark.sparkContext.broadcast(trajectories)  # as large as the caller made it

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for batch in batches:
            yield batch.assign(distance=[information_distance(joint_density(t[i], t[j], grid, width)) for i, j in zip(batch["i"], batch["j"], strict=True)])

    pairs = spark.range(count * count).select((F.col("id") / count).cast("int").alias("i"), (F.col("id") % count).cast("int").alias("j")).where("i <= j")
    return pairs.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(measure, "i int, j int, distance double")


def _reach(v: np.ndarray, low: float, high: float, bins: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The grid points within width of each value: their numbers, and 1 less the squared distances in widths (points by frames)."""
    gap = (high - low) / (bins - 1) if bins > 1 else 0.0
    most = bins if gap <= 0 else min(bins, int(2 * width / gap) + 2)
    first = np.zeros(len(v), np.int64) if most == bins else np.clip(np.ceil((v - width - low) / gap), 0, bins - 1).astype(np.int64)
    at = first + np.arange(most)[:, None]
    return np.minimum(at, bins - 1), np.where(at < bins, 1 - ((low + at * gap - v) / width) ** 2, -np.inf)


def frame_distances(df: DataFrame, features: str = "features", bins: int | None = 20, sample_rows: int | None = None, seed: int = 42, kernel: str = "epanechnikov", weights: str | None = None) -> tuple[DataFrame | None, int]:
    """(i, j, distance for all i <= j over all frames, number of features); None without frames.

    weights: a column of weights; frames of weight null or at most 0 are left out. As many frames
    as (sum of weights)^2 / sum of their squares then set the bandwidth. bins None: the root of
    the number of frames, at most MAX_BINS.
    """
    if kernel not in ("epanechnikov", "gaussian"):
        raise ValueError(f"unknown kernel {kernel!r}: epanechnikov or gaussian")
    if bins is not None and not 1 <= bins**2 <= CELLS:
        raise ValueError(f"bins must be from 1 to {int(CELLS**0.5)}")
    value = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)
    weight = F.col(weights).cast("double") if weights else F.lit(1.0)
    frames = df.where(F.col(features).isNotNull()).select(F.transform(F.col(features).cast("array<double>"), value).alias("x"), weight.alias("w")).where("w > 0")
    frames = drawn(frames, sample_rows, "x", "w", seed=seed)
    stats = to_long(frames, "x").groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("pos").toPandas()  # one row per feature
    if not len(stats):
        return None, 0
    n, spread = int(stats["n"].max()), stats["s"].to_numpy(float)
    scale = np.where(spread > 1e-12, 1 / np.where(spread > 1e-12, spread, 1.0), 0.0)
    low, high = stats["low"].to_numpy(float) * scale, stats["high"].to_numpy(float) * scale
    total = frames.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("q")).first()
    grid, width = bins or min(int(np.ceil(np.sqrt(n))), MAX_BINS), bandwidth(total["w"] ** 2 / total["q"], kernel)
    if kernel == "gaussian":
        return _gaussian_distances(frames, scale, low, high, grid, width), len(scale)
    first, second = np.triu_indices(len(scale))
    size = max(1, CELLS // grid**2)

    def summed(pairs: range):
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(pairs), grid * grid))
            used = np.unique(np.concatenate([first[pairs], second[pairs]]))
            for batch in batches:
                for start in range(0, len(batch), 1024):
                    x = np.stack(batch["x"].iloc[start : start + 1024].to_numpy()).T * scale[:, None]
                    w = batch["w"].iloc[start : start + 1024].to_numpy()
                    near = {f: _reach(x[f], low[f], high[f], grid, width) for f in used}
                    for k, p in enumerate(pairs):
                        (ia, a), (ib, b) = near[first[p]], near[second[p]]
                        cells = (ia * grid)[:, None] + ib
                        out[k] += np.bincount(cells.ravel(), (np.maximum(0.0, a[:, None] + b - 1) * w).ravel(), grid * grid)
            keep = out > 0
            keep[:, 0] = True  # a pair without density has a row too
            k, cell = np.nonzero(keep)
            for at in range(0, len(k), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pd.DataFrame({"pair": k[part] + pairs.start, "cell": cell[part].astype(np.int32), "v": out[k[part], cell[part]]})

        return frames.mapInPandas(sums, "pair long, cell int, v double")

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros(grid * grid)
        p[rows["cell"]] = rows["v"]
        p = p / p.sum() if p.sum() > 0 else np.full(grid * grid, 1 / grid**2)
        return pd.DataFrame({"i": [first[key[0]]], "j": [second[key[0]]], "distance": [information_distance(p.reshape(grid, grid))]})

    parts = [summed(range(at, min(at + size, len(first)))) for at in range(0, len(first), size)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    total = rows.groupBy("pair", "cell").agg(F.sum("v").alias("v"))
    return total.groupBy("pair").applyInPandas(measure, "i int, j int, distance double"), len(scale)


def _gaussian_distances(frames: DataFrame, scale: np.ndarray, low: np.ndarray, high: np.ndarray, grid: int, width: float) -> DataFrame:
    """i, j, distance for all i <= j: tiles of the product of every feature's kernel at its grid points."""
    points = np.linspace(low, high, grid).T
    span = max(1, TILE // grid)  # features of a tile
    parts = [np.arange(a, min(a + span, len(scale))) for a in range(0, len(scale), span)]
    places = [(a, b) for a in range(len(parts)) for b in range(a, len(parts))]
    per_pass = max(1, (16 * CELLS) // (span * grid) ** 2)

    def products_of(some: list[tuple[int, int]]):
        used = sorted({a for pair in some for a in pair})

        def products(column: pa.Array, weight: pa.Array) -> dict[tuple[int, int], np.ndarray]:
            x, w = rows_of(column) * scale, weight.to_numpy(zero_copy_only=False)
            near = {}
            for a in used:
                d = (x[:, parts[a], None] - points[parts[a]]) / width
                near[a] = np.exp(-0.5 * d * d).reshape(len(x), -1)
            return {(a, b): (near[a] * w[:, None]).T @ near[b] for a, b in some}

        return products

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tile in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["tile"], strict=True):
                cells = np.frombuffer(tile.as_buffer(), float).reshape(len(parts[a]), grid, len(parts[b]), grid)
                found = []
                for k, i in enumerate(parts[a].tolist()):
                    for m, j in enumerate(parts[b].tolist()):
                        if i <= j:
                            p = cells[k, :, m, :]
                            found.append((i, j, information_distance(p / p.sum() if p.sum() > 0 else np.full((grid, grid), 1 / grid**2))))
                i, j, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d, pa.float64())], ["i", "j", "distance"])

    passes = [tiles_of(frames, ["x", "w"], products_of(places[at : at + per_pass])) for at in range(0, len(places), per_pass)]
    tiles = passes[0]
    for more in passes[1:]:
        tiles = tiles.unionAll(more)
    return tiles.mapInArrow(measure, "i int, j int, distance double")


def distance_matrix(pairs: DataFrame, count: int) -> np.ndarray:
    rows = pairs.toPandas()  # candidates squared
    out = np.zeros((count, count))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["distance"]
    return out


def spread_seeds(d: np.ndarray, k: int) -> list[int]:
    """k members far apart: each scanned, forwards and then back, replaces the one whose exchange raises the product of distances most."""
    k = min(k, len(d))
    chosen: list[int] = []
    with np.errstate(divide="ignore"):
        logs = np.log(np.maximum(d, 1e-300))
    for i in [*range(len(d)), *range(len(d) - 1, -1, -1)]:
        if i in chosen:
            continue
        if len(chosen) < k:
            chosen.append(i)
            continue
        pull = logs[np.ix_(chosen, chosen)].sum(1) - logs[chosen, chosen]
        gain = [logs[i, chosen].sum() - logs[i, c] - pull[n] for n, c in enumerate(chosen)]
        best = int(np.argmax(gain))
        if gain[best] > 1e-12:
            chosen[best] = i
    return chosen


def medoids(d: np.ndarray, seeds: list[int]) -> tuple[list[int], float]:
    """Medoids from the given seeds and their distortion, 1 + the root of summed squared distances."""
    centres = list(dict.fromkeys(seeds))
    for _ in range(ROUNDS):
        nearest = d[:, centres].argmin(1)
        new = []
        for c, centre in enumerate(centres):
            members = np.flatnonzero(nearest == c)
            new.append(int(members[(d[np.ix_(members, members)] ** 2).sum(1).argmin()]) if len(members) else centre)
        new = list(dict.fromkeys(new))
        if set(new) == set(centres):
            break
        centres = new
    else:
        warnings.warn(f"medoids still move after {ROUNDS} rounds", stacklevel=2)
    return centres, float(1 + np.sqrt((d[:, centres].min(1) ** 2).sum()))


def best_count(distortions: list[float]) -> int:
    """The number of medoids by the jump method, the largest answer over ten exponents; distortions for 1, 2, ..."""
    answers = []
    for power in range(1, 11):
        t = np.asarray(distortions) ** (-0.5 * power)
        answers.append(int(np.argmax(np.diff(np.concatenate([[0.0], t])))) + 1)
    return max(answers)


def jumps(distortions: list[float]) -> list[float]:
    """The largest jump for each exponent."""
    return [float(np.diff(np.concatenate([[0.0], np.asarray(distortions) ** (-0.5 * p)])).max()) for p in range(1, 11)]


def distortions(d: np.ndarray, max_outputs: int | None = None) -> list[tuple[int, float, list[int]]]:
    """(number of medoids, distortion, medoids) from 1 to max_outputs (40) of them."""
    found = [(k, *medoids(d, spread_seeds(d, k))) for k in range(1, min(max_outputs or 40, len(d)) + 1)]
    return [(k, value, centres) for k, centres, value in found]


def clustered(d: np.ndarray, max_outputs: int | None = None) -> list[int]:
    found = distortions(d, max_outputs)
    return found[best_count([value for _, value, _ in found]) - 1][2]


def select_features(df: DataFrame, features: str = "features", max_outputs: int | None = None, bins: int | None = 20, sample_rows: int | None = None, kernel: str = "epanechnikov", weights: str | None = None) -> list[int]:
    """Positions of features that stand for clusters of features."""
    pairs, count = frame_distances(df, features, bins, sample_rows, kernel=kernel, weights=weights)
    return clustered(distance_matrix(pairs, count), max_outputs) if pairs is not None else []
