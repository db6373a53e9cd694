"""State discovery: diagonal Gaussian mixtures, spectral clustering by landmarks, time-lagged components.

Mixtures start from a bounded sample, drawn by digest from the whole table, and go on as partial
sums over the frames: the curve over every stride-th frame (by digest of the key), the final
fit, from several starts at once, over all. K-means starts by parallel oversampling over all
frames and moves on by mini-batches of them. Lagged pairs are taken in blocks of frames that
share a margin with the next, so a trajectory may be as long as it likes.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.features import to_long
from framelens.operators.grams import TILE, rows_of, summed_tiles, tiles_of
from framelens.operators.thresholds import knee
from framelens.sources.shared import shared_dir, stored

SAMPLE_ROWS = 10_000
#: Frames of a mini-batch, about, most batches, and frames of a block of lagged pairs.
BATCH_ROWS, MOST_BATCHES, BLOCK = 200_000, 20, 50_000
#: Starts on the weighted candidates, of which the best goes on over all frames.
RESTARTS = 40


def _population_scale(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    rows = to_long(df, features).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    s = np.array([r["s"] or 0.0 for r in rows])
    return np.array([r["m"] or 0.0 for r in rows]), np.where(s > 0, s, 1.0)


def _drawn(df: DataFrame, order: Sequence[str], features: str, rows: int) -> np.ndarray:
    """At most rows frames of the whole table, by digest of their key."""
    df = df.where(F.col(features).isNotNull()).orderBy(F.xxhash64(F.lit(7), *order), *order).limit(rows)
    x = df.select(F.col(features).cast("array<double>").alias("x")).toArrow()["x"].combine_chunks()
    return np.nan_to_num(rows_of(x)) if len(x) else np.zeros((0, 0))


def _sums_by_k(df: DataFrame, features: str, part: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """What part gives for the frames, an array for each k, summed over all of them."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for k, v in part(np.nan_to_num(np.stack(batch[features].to_numpy()).astype(float))).items():
                    out[k] = out[k] + v if k in out else v
        yield pd.DataFrame({"i": np.array(list(out), np.int32), "j": np.int32(0), "tile": [v.astype(float).tobytes() for v in out.values()]})

    rows = summed_tiles(df.select(features).mapInPandas(sums, "i int, j int, tile binary"))
    return {r["i"]: np.frombuffer(r["tile"]) for r in rows.collect()}  # one row per k


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log weight plus log density of every component at every row."""
        p = 1 / self.variances
        square = (x**2) @ p.T - 2 * x @ (self.means * p).T + (self.means**2 * p).sum(1)
        return np.log(self.weights) - 0.5 * (square + np.log(2 * np.pi * self.variances).sum(1))

    def bic(self, log_likelihood: float, n: int) -> float:
        k, d = self.means.shape
        return -2 * log_likelihood + (k - 1 + 2 * k * d) * np.log(max(n, 1))

    def step(self, parts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        top = parts.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(parts - top).sum(1))
        r = np.exp(parts - total[:, None])
        return r.sum(0), r.T @ x, r.T @ (x * x), float(total.sum())


def _updated(n: np.ndarray, s: np.ndarray, q: np.ndarray, floor: float) -> Mixture:
    n = np.maximum(n, 1e-10)
    means = s / n[:, None]
    return Mixture(n / n.sum(), means, np.maximum(q / n[:, None] - means**2, 0) + floor)


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Centres and inertia, from spread-out starts."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c, float(((x - c[nearest(x, c)]) ** 2).sum())


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def fit_local(x: np.ndarray, k: int, seed: int = 42, steps: int = 100, tolerance: float = 1e-3, floor: float = 1e-4) -> tuple[Mixture, float]:
    own = nearest(x, kmeans(x, k, seed)[0])
    r = np.eye(k)[own]
    model, last = _updated(r.sum(0), r.T @ x, r.T @ (x * x), floor), -np.inf
    for _ in range(steps):
        n, s, q, value = model.step(model.log_parts(x), x)
        model = _updated(n, s, q, floor)
        if abs(value - last) < tolerance * len(x):
            break
        last = value
    return model, value


def mixture_states(df: DataFrame, order: Sequence[str], features: str = "features", max_k: int = 15, stride: int = 5, sensitivity: float = 1.0, starts: int = 10, steps: int = 1000, tolerance: float = 1e-4, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(df with global_cluster_id, table of k, bic, chosen and converged).

    The number of components is the knee of the criterion over every stride-th frame, or its
    least value; the best of several starts with that number is fitted on all frames. Warns
    if that fit has not converged after steps passes.
    """
    spark = df.sparkSession
    shift, scale = _population_scale(df, features)
    strided = df.where(F.pmod(F.xxhash64(*order), F.lit(stride)) == 0).select(*order, features).persist()
    n = strided.count()
    x = (_drawn(strided, order, features, sample_rows) - shift) / scale
    fits = mixtures(strided, features, {k: fit_local(x, k, seed)[0] for k in range(2, max_k + 1) if k < min(n, len(x))}, shift, scale, 500, 1e-3)
    strided.unpersist()
    if not fits:
        raise ValueError("too few frames for a mixture")
    ks = sorted(fits)
    bics = [float(fits[k][0].bic(fits[k][1], n)) for k in ks]
    found = knee(bics, 2.0, sensitivity)
    k = int(found[0]) if found else ks[int(np.argmin(bics))]
    model = fits[k][0]
    if starts > 0:
        x = (_drawn(df, order, features, sample_rows) - shift) / scale
        first = {i: fit_local(x, k, seed + i, steps, tolerance)[0] for i in range(starts) if k <= len(x)} | {starts: model}
        best = max(mixtures(df, features, first, shift, scale, steps, tolerance).values(), key=lambda f: f[1])
        model = best[0]
        if not best[2]:
            warnings.warn(f"the mixture of {k} has not converged after {steps} passes", stacklevel=2)

    @F.pandas_udf("int")
    def label(v: pd.Series) -> pd.Series:
        return pd.Series(model.log_parts((np.nan_to_num(np.stack(v.to_numpy()).astype(float)) - shift) / scale).argmax(1).astype(np.int32))

    curve = spark.createDataFrame([(i, bic, bool(i == k), bool(fits[i][2])) for i, bic in zip(ks, bics, strict=True)], "k int, bic double, chosen boolean, converged boolean")
    return df.withColumn("global_cluster_id", label(features)), curve


def mixtures(df: DataFrame, features: str, models: dict[int, Mixture], shift: np.ndarray, scale: np.ndarray, steps: int, tolerance: float, floor: float = 1e-4) -> dict[int, tuple[Mixture, float, bool]]:
    """Each of the models fitted to all rows of df, its log likelihood, and whether it converged.

    A pass over the rows is a step of all models that still move; a model leaves when its mean
    log likelihood gains less than tolerance.
    """
    models, values, going, d = dict(models), dict.fromkeys(models, -np.inf), set(models), len(scale)
    for _ in range(steps):
        if not going:
            break
        now = {i: models[i] for i in going}

        def part(v: np.ndarray, now=now) -> dict[int, np.ndarray]:
            z = (v - shift) / scale
            return {i: np.concatenate([np.ravel(a) for a in m.step(m.log_parts(z), z)] + [[len(z)]]) for i, m in now.items()}

        for i, sums in _sums_by_k(df, features, part).items():
            value, n = sums[-2:]
            done = abs(value - values[i]) < tolerance * n
            values[i] = float(value)
            if done:
                going.discard(i)  # the model that the value is of stays
            else:
                k = len(models[i].weights)
                models[i] = _updated(sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : k + 2 * k * d].reshape(k, d), floor)
    return {i: (models[i], values[i], i not in going) for i in models}


def _labelled(df: DataFrame, embed, centres: np.ndarray, features: str) -> DataFrame:
    @F.pandas_udf("short")
    def label(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(embed(np.nan_to_num(np.stack(v.to_numpy()).astype(float))), centres).astype(np.int16))

    return df.withColumn("global_cluster_id", label(features))


def embedded(df: DataFrame, order: Sequence[str], features: str, embed: Callable[[np.ndarray], np.ndarray], batch_rows: int = BATCH_ROWS) -> tuple[DataFrame, int]:
    """(batch, u, x) for each frame, stored a folder a batch: its mini-batch, a uniform number by digest of its key, its embedding; and how many batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = embed(np.nan_to_num(np.stack(part[features].to_numpy()).astype(float)))
                yield pd.DataFrame({"batch": part["batch"], "u": part["u"], "x": list(x)})

    # Batches of about batch_rows frames, at most MOST_BATCHES.
    count = int(np.clip(-(-df.count() // batch_rows), 1, MOST_BATCHES))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(5), *order), 11) + 0.5) / float(1 << 53)
    rows = df.select(F.pmod(F.xxhash64(F.lit(3), *order), F.lit(count)).cast("int").alias("batch"), u.alias("u"), features)
    path = f"{shared_dir(df.sparkSession)}/embedded-{uuid.uuid4().hex}"
    rows.mapInPandas(run, "batch int, u double, x array<double>").write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema("u double, x array<double>, batch int").parquet(path), count


def _least_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its nearest centre."""
    return np.maximum(((centres**2).sum(1) - 2 * x @ centres.T).min(1) + (x**2).sum(1), 0)


def seeds(frames: DataFrame, most: int, rounds: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, how many frames are nearest to each) by parallel oversampling.

    A round draws 2 * most frames with chances in proportion to their squared distance from the
    candidates so far: those with the least log(1 / u) / distance, which tasks keep as a short
    list each. So at most 2 * most * rounds + 1 frames ever come to the driver.
    """

    def draw(centres: np.ndarray | None, k: int, turn: int) -> np.ndarray:
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"e": np.zeros(0), "x": np.zeros(0, object)})  # a task without frames has lists, too
            for part in batches:
                if len(part):
                    x = np.stack(part["x"].to_numpy())
                    d = _least_squares(x, centres) if centres is not None else np.ones(len(x))
                    u = np.mod(part["u"].to_numpy() * (1 + 0.618034 * turn) + 0.754877 * turn * seed, 1.0)
                    with np.errstate(divide="ignore"):
                        e = np.where(d > 1e-12, -np.log(np.clip(u, 1e-300, 1.0)) / d, np.inf)
                    kept = pd.concat([kept, pd.DataFrame({"e": e, "x": part["x"]})]).nsmallest(k, "e", keep="first")
            yield kept[np.isfinite(kept["e"].astype(float))]

        rows = frames.select("u", "x").mapInPandas(best, "e double, x array<double>").orderBy("e", "x").limit(k).select("x").collect()
        return np.array([r["x"] for r in rows])

    found = draw(None, 1, 0)
    for turn in range(1, rounds + 1):
        more = draw(found, 2 * most, turn)
        if not len(more):
            break
        found = np.unique(np.vstack([found, more]), axis=0)

    def part(x: np.ndarray) -> dict[int, np.ndarray]:
        return {0: np.bincount(nearest(x, found), minlength=len(found)).astype(float)}

    return found, _sums_by_k(frames, "x", part)[0]


def weighted_kmeans(x: np.ndarray, weights: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """Centres of weighted rows, from spread-out starts."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.choice(len(x), p=weights / weights.sum())]]
    for _ in range(k - 1):
        d = _least_squares(x, np.array(centres)) * weights
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        new = np.array([np.average(x[own == i], axis=0, weights=weights[own == i]) if weights[own == i].sum() > 0 else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def mini_batch_kmeans(frames: DataFrame, batches: int, ks: Sequence[int], seed: int = 42, epochs: int = 20, tolerance: float = 1e-3) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and inertia over all frames for each k.

    A step reads one batch and moves every centre to the mean of all frames it was given in this
    epoch; with one batch that is Lloyd's step. An epoch ends with the inertia over all frames,
    and a k leaves when an epoch lowers that by less than tolerance of it.
    """
    candidates, weights = seeds(frames, max(ks), seed=seed)
    starts = [min((weighted_kmeans(candidates, weights, k, seed + i) for i in range(RESTARTS)), key=lambda c: (weights * _least_squares(candidates, c)).sum()) for k in ks if k <= len(candidates)]
    centres = {len(c): c for c in starts}
    inertia, best, going = dict.fromkeys(centres, np.inf), dict(centres), set(centres)
    d = candidates.shape[1]

    def sums(rows: DataFrame) -> dict[int, np.ndarray]:
        now = {k: centres[k] for k in going}

        def part(x: np.ndarray) -> dict[int, np.ndarray]:
            out = {}
            for k, c in now.items():
                own = nearest(x, c)
                member = np.eye(k)[own]
                out[k] = np.concatenate([member.sum(0), (member.T @ x).ravel(), [((x - c[own]) ** 2).sum()]])
            return out

        return _sums_by_k(rows, "x", part)

    def settle(found: dict[int, np.ndarray]) -> None:
        for k, v in found.items():
            value = float(v[-1])
            if value < inertia[k]:
                best[k] = centres[k]
            if not value < inertia[k] * (1 - tolerance):
                going.discard(k)
            inertia[k] = min(inertia[k], value)

    for _ in range(epochs):
        totals: dict[int, np.ndarray] = {}
        for b in range(batches):
            found = sums(frames.where(F.col("batch") == b))
            if batches == 1:
                settle(found)  # the sums of a whole pass hold the inertia of its centres
            for k in going & found.keys():
                totals[k] = totals.get(k, 0) + found[k]
                n, s = totals[k][:k, None], totals[k][k:-1].reshape(k, d)
                centres[k] = np.where(n > 0, s / np.maximum(n, 1), centres[k])
        if batches > 1 and going:
            settle(sums(frames))
        if not going:
            break
    return {k: (best[k], inertia[k]) for k in centres}


def _by_inertia(df: DataFrame, order: Sequence[str], features: str, embed, most: int, fallback: int, seed: int, sensitivity: float = 1.0) -> np.ndarray:
    """Centres of all embedded frames, as many as the knee of the inertia says."""
    fits = mini_batch_kmeans(*embedded(df, order, features, embed), range(2, most + 1), seed)
    ks = sorted(fits)
    found = knee([fits[k][1] for k in ks], 2.0, sensitivity)
    return fits[int(found[0]) if found else min(fallback, ks[-1])][0]


def spectral_states(df: DataFrame, order: Sequence[str], features: str = "features", components: int = 100, max_k: int = 15, seed: int = 42) -> DataFrame:
    """df with global_cluster_id from a radial kernel's features at landmarks, frames drawn by digest of their key."""
    shift, scale = _population_scale(df, features)
    landmarks = (_drawn(df, order, features, components) - shift) / scale
    gamma = 1 / landmarks.shape[1]

    def kernel(a: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] - 2 * a @ landmarks.T + (landmarks**2).sum(1), 0))

    values, vectors = np.linalg.eigh(kernel(landmarks))
    root = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
    embed = lambda v: kernel((v - shift) / scale) @ root
    centres = _by_inertia(df, order, features, embed, max_k, 5, seed)
    return _labelled(df, embed, centres, features)


def in_blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], lag: int, block: int = BLOCK) -> DataFrame:
    """key, columns, place, block of all frames in order, and of the first lag frames of each block once more at the end of the block before.

    Frames are range-partitioned by key and order and numbered by their partition's offset and
    their place in it, so neither a trajectory nor a partition is ever gathered.
    """
    size = max(block, 2 * lag)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*key, *order, *[c for c in columns if c not in (*key, *order)])
    placed = stored(rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    offsets = df.sparkSession.createDataFrame([(int(p), int(b)) for (p, _), b in zip(sizes, before, strict=False)], "_p long, _before long")
    numbered = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    own = F.expr(f"place div {size}")
    twice = F.when((F.col("place") % size < lag) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return numbered.select(*key, *[c for c in columns if c not in key], "place", F.explode(twice).alias("block"))


def _pairs(key: Sequence[str], column: str, lag: int, give: Callable):
    """What give makes of (batch of frames, batch of the frames lag later) of one trajectory each, from rows sorted by block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out = None, give()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            n = table.num_rows - lag
            if n > 0:
                first, later = table.slice(0, n), table.slice(lag, n)
                same = np.asarray(pc.equal(first["block"], later["block"]).combine_chunks())
                for k in key:
                    both = pc.or_kleene(pc.and_kleene(pc.is_null(first[k]), pc.is_null(later[k])), pc.fill_null(pc.equal(first[k], later[k]), False))
                    same &= np.asarray(both.combine_chunks())
                # A block's frames follow each other without a gap, so lag rows on is lag frames on.
                keep = pa.array(same)
                yield from out.add(first[column].filter(keep), later[column].filter(keep))
            rest = table.slice(max(n, 0), lag).combine_chunks()
        yield from out.end()

    return run


class _Rows:
    """Gives the pairs themselves."""

    def add(self, x: pa.ChunkedArray, y: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        if len(x):
            yield pa.RecordBatch.from_arrays([x.combine_chunks(), y.combine_chunks()], ["x", "later"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def lag_pairs(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, lag: int, block: int = BLOCK) -> DataFrame:
    """x, later: a column's value in each frame and lag frames on in the same trajectory."""
    kind = df.schema[column].dataType.simpleString()
    blocks = in_blocks(df, key, order, [column], lag, block)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "block").sortWithinPartitions("block", "place").mapInArrow(_pairs(key, column, lag, _Rows), f"x {kind}, later {kind}")


def lagged_sums(df: DataFrame, key: Sequence[str], order: Sequence[str], features: str, lag: int, shift: np.ndarray, scale: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """Symmetrised covariances at lag 0 and at lag, over pairs within a trajectory, and the number of pairs."""
    d = len(scale)

    def products(x: pa.Array, y: pa.Array) -> dict[tuple[int, int], np.ndarray]:
        a, b = (np.nan_to_num((rows_of(v) - shift) / scale) for v in (x, y))
        tile = lambda m, i, j: m[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE]
        count = -(-d // TILE)
        whole = a.T @ a + b.T @ b, a.T @ b + b.T @ a
        out = {(i, j): np.stack([tile(m, i, j) for m in whole]) for i in range(count) for j in range(count)}
        return out | {(-1, 0): np.array([float(len(a))])}

    pairs = lag_pairs(df, key, order, features, lag, block).where("x is not null and later is not null")
    c0, ct, n = np.zeros((d, d)), np.zeros((d, d)), 0.0
    for r in tiles_of(pairs, ["x", "later"], products).collect():  # features squared numbers
        own = np.frombuffer(r["tile"], float)
        if r["i"] < 0:
            n = float(own[0])
        else:
            i, j = r["i"] * TILE, r["j"] * TILE
            both = own.reshape(2, min(TILE, d - i), min(TILE, d - j))
            c0[i : i + TILE, j : j + TILE], ct[i : i + TILE, j : j + TILE] = both
    return c0 / max(2 * n, 1), ct / max(2 * n, 1), n


def time_lagged_states(df: DataFrame, key: Sequence[str], order: Sequence[str], features: str = "features", lag: int = 10, components: int = 6, max_k: int = 11, seed: int = 42) -> DataFrame:
    """df with global_cluster_id, TICA_1 and TICA_2 from time-lagged independent components (kinetic map)."""
    shift, scale = _population_scale(df, features)
    c0, ct, n = lagged_sums(df, key, order, features, lag, shift, scale)
    if not n:
        raise ValueError("no trajectory is longer than the lag")
    values, vectors = np.linalg.eigh(c0)
    good = values > 1e-10 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    slow, turn = np.linalg.eigh(white.T @ ct @ white)
    order_ = np.argsort(-slow)[:components]
    matrix = white @ turn[:, order_] * np.clip(slow[order_], 0, None)
    embed = lambda v: (v - shift) / scale @ matrix
    centres = _by_inertia(df, [*key, *order], features, embed, max_k, 4, seed)

    @F.pandas_udf("array<double>")
    def two(v: pd.Series) -> pd.Series:
        return pd.Series(list(embed(np.nan_to_num(np.stack(v.to_numpy()).astype(float)))[:, :2]))

    out = _labelled(df, embed, centres, features).withColumn("_t", two(features))
    return out.withColumn("TICA_1", F.get("_t", F.lit(0))).withColumn("TICA_2", F.get("_t", F.lit(1))).drop("_t")
