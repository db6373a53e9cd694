"""Supervised feature selection: greedy relevance over redundancy, and two particle swarms.

Scores, correlations and the fitness of a swarm are aggregated by Spark over all rows (of
``sample_rows`` frames only where a caller asks for it). The fitness is that of small linear
classifiers in cross-validation: every Newton step of all classifiers of all particles is one
pass of partial sums over blocks of frames, and so is the count of frames they get right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.features import gather
from framelens.operators import moments as M
from framelens.operators.reduction import correlation, scatter
from framelens.operators.thresholds import knee

#: Frames of a block.
BLOCK = 2000
#: Frames of a block that are multiplied at once.
CACHED = 500
#: Parts that a class is dealt to folds in.
BUCKETS = 1024
NEWTON_STEPS = 12
#: Chances of at most 0, 1, ... draws of a frame in a bootstrap.
_DRAWS = np.cumsum([0.36787944117144233 / np.prod(np.arange(1.0, k + 1)) for k in range(16)])


def relevance_order(relevance: np.ndarray, correlated: np.ndarray, count: int) -> list[int]:
    """Greedy order: the most relevant first, then by relevance over mean correlation with those chosen."""
    count = min(count, len(relevance))
    if not count:
        return []
    chosen = [int(np.argmax(relevance))]
    running = correlated[chosen[0]].copy()
    while len(chosen) < count:
        score = relevance / (running / len(chosen) + 1e-5)
        score[chosen] = -np.inf
        best = int(np.argmax(score))
        chosen.append(best)
        running += correlated[best]
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the last is the offset) of a linear classifier with squared hinge loss, y in -1, 1; by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        slack = 1 - y * (z @ w)
        on = slack > 0
        active = z[on]
        grad = w - 2 * c * active.T @ (slack[on] * y[on])
        if np.linalg.norm(grad) < 1e-6 * max(1, len(x)):
            break
        w = w - np.linalg.solve(np.eye(len(w)) + 2 * c * active.T @ active, grad)
    return w


def decide(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    return (np.column_stack([x, np.ones(len(x))]) @ np.array(models).T).argmax(1)


def folds(y: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """A fold for every row, each class dealt out evenly."""
    out = np.zeros(len(y), int)
    rng = np.random.default_rng(seed)
    for c in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at] = np.arange(len(at)) % count
    return out


def accuracy(x: np.ndarray, y: np.ndarray, cv: int = 3, bags: int = 0, seed: int = 42) -> float:
    """Mean cross-validated accuracy of one-against-rest classifiers, bagged if bags."""
    count = min(cv, int(np.bincount(y).min()))
    if count < 2:
        return 0.0
    fold, scores, rng = folds(y, count, seed), [], np.random.default_rng(seed)
    for k in range(count):
        train, test = fold != k, fold == k
        votes = np.zeros((int(test.sum()), int(y.max()) + 1))
        for _ in range(max(bags, 1)):
            at = np.flatnonzero(train)
            at = rng.choice(at, len(at)) if bags else at
            models = [fit_svm(x[at], np.where(y[at] == c, 1.0, -1.0)) for c in range(int(y.max()) + 1)]
            votes[np.arange(len(votes)), decide(x[test], models)] += 1
        scores.append(float((votes.argmax(1) == y[test]).mean()))
    return float(np.mean(scores))


def binary_fitness(position: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float = 0.95, threshold: float = 0.5, cv: int = 3) -> float:
    """alpha times the error plus the rest times the share of features used; 1 for none."""
    mask = position > threshold
    if not mask.any() or not len(y) or np.bincount(y).min() < 2:
        return 1.0
    return binary_loss(accuracy(x[:, mask], y, cv), mask, alpha)


def binary_loss(right: float, mask: np.ndarray, alpha: float) -> float:
    return alpha * (1 - right) + (1 - alpha) * mask.sum() / len(mask)


def mean_projection(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return x @ chosen / (chosen.sum(0) + 1e-12)


def projection_fitness(position: np.ndarray, x: np.ndarray, y: np.ndarray, dimensions: int, alpha: float = 0.9, threshold: float = 0.5, weight: float = 0.2, cv: int = 3, bags: int = 5) -> float:
    """Error and sparsity of mean-of-features dimensions, with penalties for redundant and overlapping ones."""
    chosen = (position.reshape(x.shape[1], dimensions) > threshold).astype(float)
    if (chosen.sum(0) == 0).any() or not len(y) or np.bincount(y).min() < 2:
        return 1.0
    z = mean_projection(x, chosen)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.atleast_2d(np.corrcoef(z.T)))
    return projection_loss(accuracy(z, y, cv, bags), chosen, r, alpha, weight)


def projection_loss(right: float, chosen: np.ndarray, r: np.ndarray, alpha: float, weight: float) -> float:
    """r: the correlations of the dimensions."""
    dimensions = chosen.shape[1]
    loss = alpha * (1 - right) + (1 - alpha) * chosen.mean()
    redundancy = ((r * r).sum() - dimensions) / (dimensions * (dimensions - 1)) if dimensions > 1 else 0.0
    used = chosen.sum(1)  # how many dimensions use each feature
    overlap = used[used > 1].sum() / chosen.size if dimensions > 1 else 0.0
    return float((1 - weight) * loss + weight * (0.7 * redundancy + 0.3 * overlap))


def swarm(evaluate: Callable[[np.ndarray], np.ndarray], size: int, particles: int, steps: int, seed: int = 42, w: float = 0.729, c1: float = 1.49445, c2: float = 1.49445) -> tuple[np.ndarray, float]:
    """Best position in [0, 1]^size and its value. evaluate takes all particles of an iteration at once."""
    rng = np.random.default_rng(seed)
    x = rng.random((particles, size))
    v = rng.uniform(-0.5, 0.5, (particles, size))
    own, value = x.copy(), evaluate(x)
    for _ in range(steps):
        best = own[value.argmin()]
        v = np.clip(w * v + c1 * rng.random(x.shape) * (own - x) + c2 * rng.random(x.shape) * (best - x), -1, 1)
        x = np.clip(x + v, 0, 1)
        now = evaluate(x)
        better = now < value
        own[better], value[better] = x[better], now[better]
    return own[value.argmin()], float(value.min())


@dataclass
class Frames:
    """All frames of a selection in blocks, each with its class and its fold; classes are dealt evenly to folds."""

    blocks: DataFrame
    sizes: np.ndarray
    width: int
    classes: int
    total: np.ndarray

    @property
    def folds(self) -> int:
        return len(self.sizes)

    def accuracies(self, views: list[np.ndarray], bags: int = 0, c: float = 1.0) -> np.ndarray:
        """Mean cross-validated accuracy of one-against-rest classifiers on the frames times each view (width by dimensions)."""
        return self.fitted(views, [None] * len(views), bags, c)[0]

    def fitted(self, views: list[np.ndarray], starts: list[np.ndarray | None], bags: int = 0, c: float = 1.0) -> tuple[np.ndarray, list[np.ndarray]]:
        """(accuracies, weights by fold, bag, class and dimension) of each view.

        Newton's steps begin at the weights in starts, where there are any. The classifiers have one
        best fit, so a start changes how many passes it takes, not what is found.
        """
        shape = (self.folds, max(bags, 1), self.classes)
        weights = [np.zeros((*shape, v.shape[1] + 1)) if w is None else w.copy() for v, w in zip(views, starts, strict=True)]
        if self.folds < 2:
            return np.zeros(len(views)), weights
        on = [np.ones(shape, bool) for _ in views]
        for _ in range(NEWTON_STEPS):
            rows = self.blocks.mapInPandas(_newton_sums(views, weights, on, bags), "view int, sums binary")
            steps = rows.groupBy("view").applyInPandas(_newton_step(weights, on, self.sizes, c), "view int, weights binary, active binary").collect()
            for r in steps:
                weights[r["view"]] = np.frombuffer(r["weights"]).reshape(weights[r["view"]].shape)
                on[r["view"]] = np.frombuffer(r["active"], bool).reshape(shape)
            if not any(x.any() for x in on):
                break
        hits = self.blocks.mapInPandas(_hits(views, weights), "view int, fold int, hits long").groupBy("view", "fold").agg(F.sum("hits").alias("hits")).toPandas()
        out = np.zeros((len(views), self.folds))
        out[hits["view"], hits["fold"]] = hits["hits"]
        return (out / self.sizes).mean(1), weights


def _unpacked(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    for x, y, fold, row in zip(batch["x"], batch["y"], batch["fold"], batch["row"], strict=True):
        y = np.frombuffer(y, np.int32)
        yield np.frombuffer(x).reshape(len(y), -1), y, np.frombuffer(fold, np.int32), np.frombuffer(row, np.uint64)


def _offset(x: np.ndarray, view: np.ndarray) -> np.ndarray:
    return np.column_stack([x @ view, np.ones(len(x))])


def draws(row: np.ndarray, number: int) -> np.ndarray:
    """How often each frame is in bootstrap number: 0, 1, ... as drawing with replacement from many frames gives."""
    z = row * np.uint64(0x9E3779B97F4A7C15) + np.uint64((number + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = z ^ (z >> np.uint64(31))
    return np.searchsorted(_DRAWS, (z >> np.uint64(11)) / 2.0**53, "right").astype(float)


def _newton_sums(views: list[np.ndarray], weights: list[np.ndarray], on: list[np.ndarray], bags: int):
    """Per view the sums of its classifiers still on: slope and curvature of the squared hinge loss, by fold, bag and class.

    All classifiers of a view are the columns of one product: products of two dimensions times the frames' weights in each.
    """
    folds, each, classes = on[0].shape
    left = [v for v in range(len(views)) if on[v].any()]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which = {v: np.nonzero(on[v]) for v in left}
        own = {v: weights[v][on[v]].T for v in left}
        upper = {v: np.triu_indices(len(own[v])) for v in left}
        curvature = {v: np.zeros((len(upper[v][0]), own[v].shape[1])) for v in left}
        slope = {v: np.zeros(own[v].shape) for v in left}
        for batch in batches:
            for block in _unpacked(batch):
                for start in range(0, len(block[1]), CACHED):
                    x, y, fold, row = (a[start : start + CACHED] for a in block)
                    times = np.column_stack([(fold != k) * (draws(row, k * bags + b) if bags else 1.0) for k in range(folds) for b in range(each)])
                    signs = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
                    for v in left:
                        k, b, c = which[v]
                        z, sign = _offset(x, views[v]), signs[:, c]
                        slack = 1 - sign * (z @ own[v])
                        weighed = times[:, k * each + b] * (slack > 0)
                        across = np.ascontiguousarray(z.T)
                        curvature[v] += (across[upper[v][0]] * across[upper[v][1]]) @ weighed
                        slope[v] += across @ (weighed * slack * sign)
        out = []
        for v in left:
            d, count = slope[v].shape
            total = np.zeros((count, d, d + 1))
            i, j = upper[v]
            total[:, i, j] = total[:, j, i] = curvature[v].T
            total[:, :, -1] = slope[v].T
            out.append(total.tobytes())
        yield pd.DataFrame({"view": np.array(left, np.int32), "sums": out})

    return sums


def _newton_step(weights: list[np.ndarray], on: list[np.ndarray], sizes: np.ndarray, penalty: float):
    least = [1e-6 * max(1, sizes.sum() - n) for n in sizes]

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = int(key[0])
        w, active = weights[v].copy(), on[v].copy()
        d = w.shape[-1]
        sums = np.sum([np.frombuffer(r) for r in rows["sums"]], 0).reshape(-1, d, d + 1)
        for (k, b, c), s in zip(np.argwhere(on[v]), sums, strict=True):
            slope = w[k, b, c] - 2 * penalty * s[:, -1]
            if np.linalg.norm(slope) < least[k]:
                active[k, b, c] = False
            else:
                w[k, b, c] -= np.linalg.solve(np.eye(d) + 2 * penalty * s[:, :-1], slope)
        return pd.DataFrame({"view": [v], "weights": [w.tobytes()], "active": [active.tobytes()]})

    return step


def _hits(views: list[np.ndarray], weights: list[np.ndarray]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros((len(views), len(weights[0])), np.int64)
        for batch in batches:
            for x, y, fold, _ in _unpacked(batch):
                for k in range(hits.shape[1]):
                    test = fold == k
                    xk, yk = x[test], y[test]
                    for v, view in enumerate(views):
                        z = _offset(xk, view)
                        votes = np.zeros((len(yk), weights[v].shape[2]))
                        for w in weights[v][k]:
                            votes[np.arange(len(yk)), (z @ w.T).argmax(1)] += 1
                        hits[v, k] += (votes.argmax(1) == yk).sum()
        v, k = np.divmod(np.arange(hits.size), hits.shape[1])
        yield pd.DataFrame({"view": v.astype(np.int32), "fold": k.astype(np.int32), "hits": hits.ravel()})

    return count


def drawn(df: DataFrame, rows: int | None, *by: str, seed: int = 42) -> DataFrame:
    """df, or where rows is given so many of its rows by digest."""
    return df if rows is None else df.orderBy(F.xxhash64(F.lit(seed), *by), *by[:1]).limit(rows)


def packed(df: DataFrame, target: str, features: str, cv: int = 3, sample_rows: int | None = None, seed: int = 42) -> Frames:
    """The frames that have a class, in blocks that stay stored until blocks.unpersist()."""
    value = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)
    frames = df.where(F.col(target).isNotNull() & F.col(features).isNotNull())
    frames = frames.select(F.transform(F.col(features).cast("array<double>"), value).alias("x"), F.col(target).alias("_c"))
    frames = drawn(frames, sample_rows, "x", "_c", seed=seed)
    counts = sorted((r["_c"], r["count"]) for r in frames.groupBy("_c").count().collect())  # one row per class
    n = np.array([c for _, c in counts], np.int64)
    folds = min(cv, int(n.min())) if len(n) else 0
    if folds < 2:
        return Frames(frames, np.zeros(0, int), 0, len(n), np.zeros((0, 0)))
    s = scatter(frames, "_c", "x")
    number = F.coalesce(*[F.when(F.col("_c") == F.lit(c), F.lit(i)) for i, (c, _) in enumerate(counts)])
    frames = frames.select("x", number.alias("y"), F.xxhash64(F.lit(seed), "x", "_c").alias("_h")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    before = Window.partitionBy("y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = frames.groupBy("y", "_b").count().select("y", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))  # classes by BUCKETS rows
    dealt = frames.join(F.broadcast(starts), ["y", "_b"]).withColumn("row", F.col("_s") + F.row_number().over(Window.partitionBy("y", "_b").orderBy("_h", "x")) - 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                y, row = part["y"].to_numpy(np.int32), part["row"].to_numpy(np.int64)
                own = (row * len(n) + y).astype(np.uint64)
                yield pd.DataFrame({"x": [np.stack(part["x"].to_numpy()).astype(float).tobytes()], "y": [y.tobytes()], "fold": [(row % folds).astype(np.int32).tobytes()], "row": [own.tobytes()]})

    blocks = dealt.select("x", "y", "row").mapInPandas(pack, "x binary, y binary, fold binary, row binary")
    sizes = np.array([sum(-(-(int(c) - k) // folds) for c in n) for k in range(folds)])
    return Frames(blocks.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(), sizes, s.means.shape[1], len(n), s.within + s.between)


def evaluated(loss: Callable[[list[np.ndarray], list], tuple[np.ndarray, list]], threshold: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """Evaluates the particles of an iteration together, each different mask once.

    loss gives values and states of masks, from the states that their particles' masks of the
    iteration before had.
    """
    known: dict[bytes, tuple[float, object]] = {}
    last: list[bytes] = []

    def run(x: np.ndarray) -> np.ndarray:
        masks = [np.packbits(p > threshold).tobytes() for p in x]
        new = {m: i for i, m in reversed(list(enumerate(masks))) if m not in known}
        if new:
            states = [known[last[i]][1] if last else None for i in new.values()]
            values, states = loss([x[i] > threshold for i in new.values()], states)
            known.update({m: (float(v), s) for m, v, s in zip(new, values, states, strict=True)})
        last[:] = masks
        for m in known.keys() - set(masks):
            known[m] = (known[m][0], None)  # only the present masks are starts
        return np.array([known[m][0] for m in masks])

    return run


def binary_losses(frames: Frames, masks: list[np.ndarray], alpha: float = 0.95, starts: list | None = None) -> tuple[np.ndarray, list]:
    """binary_fitness of each mask over all frames, and the classifiers' weights on all features (0 where unused)."""
    out, states = np.ones(len(masks)), [None] * len(masks)
    some = [i for i, m in enumerate(masks) if m.any()] if frames.folds > 1 else []
    if some:
        used = {i: np.append(masks[i], True) for i in some}  # and the offset
        own = [starts[i][..., used[i]] if starts and starts[i] is not None else None for i in some]
        right, weights = frames.fitted([np.eye(frames.width)[:, masks[i]] for i in some], own)
        for i, a, w in zip(some, right, weights, strict=True):
            out[i] = binary_loss(a, masks[i], alpha)
            states[i] = np.zeros((*w.shape[:-1], frames.width + 1))
            states[i][..., used[i]] = w
    return out, states


def projection_losses(frames: Frames, masks: list[np.ndarray], dimensions: int, alpha: float = 0.9, weight: float = 0.2, bags: int = 5, starts: list | None = None) -> tuple[np.ndarray, list]:
    """projection_fitness of each mask over all frames, and the classifiers' weights on the dimensions."""
    out, states = np.ones(len(masks)), [None] * len(masks)
    chosen = [m.reshape(-1, dimensions).astype(float) for m in masks]
    some = [i for i, m in enumerate(chosen) if m.sum(0).all()] if frames.folds > 1 else []
    if some:
        views = [chosen[i] / (chosen[i].sum(0) + 1e-12) for i in some]
        right, weights = frames.fitted(views, [starts[i] if starts else None for i in some], bags)
        for i, view, a, w in zip(some, views, right, weights, strict=True):
            joint = view.T @ frames.total @ view
            norm = np.sqrt(np.diag(joint))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[i] = projection_loss(a, chosen[i], np.nan_to_num(joint / np.outer(norm, norm)), alpha, weight)
            states[i] = w
    return out, states


def strided(df: DataFrame, target: str, features: str, stride: int, seed: int) -> DataFrame:
    """About every stride-th frame, by digest of its values."""
    return df if stride <= 1 else df.where(F.pmod(F.xxhash64(F.lit(seed), target, features), F.lit(stride)) == 0)


def rounds(select: Callable[[list[int] | None], list[int]], most: int, save: str | None = None, spark=None) -> list[int]:
    """What select chooses from its own choice of the round before, until that stays the same, at most so often.

    With save, each round is stored there when it ends, and a later call goes on behind the last one.
    """
    chosen, done = None, 0
    if save is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(save)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            for r in spark.read.schema("round int, chosen array<int>, settled boolean").parquet(save).orderBy("round").collect():  # one row per round
                done, chosen = r["round"], list(r["chosen"])
                if r["settled"]:
                    return chosen
    for k in range(done + 1, most + 1):
        now = select(chosen)
        settled = chosen is not None and set(now) == set(chosen)
        chosen = now
        if save is not None:
            spark.createDataFrame([(k, [int(p) for p in now], settled)], "round int, chosen array<int>, settled boolean").coalesce(1).write.mode("append").parquet(save)
        if settled:
            break
    return chosen or []


def candidates(df: DataFrame, target: str, features: str, limit: int | None, sensitivity: float, fallback: int) -> tuple[list[int], np.ndarray]:
    """Positions of the highest Fisher scores (a number of them, or up to the knee) and the scores."""
    rows = M.ranked(M.fisher_scatter(M.class_moments(df, target, features))).orderBy("rank").collect()  # one per feature
    scores = [r["score"] or 0.0 for r in rows]
    if limit is None:
        found = knee(scores, 0.0, sensitivity)
        limit = int(found[0]) + 1 if found else fallback
    return [r["pos"] for r in rows[:limit]], np.array(scores[:limit])


def shortlist(df: DataFrame, target: str, features: str, limit: int | None, sensitivity: float, fallback: int, mrmr_limit: int) -> list[int]:
    positions, scores = candidates(df, target, features, limit, sensitivity, fallback)
    if not positions:
        raise ValueError("no features to choose from")
    cut = gather(df, positions, features)
    return [positions[i] for i in relevance_order(scores, correlation(scatter(cut, target, features)), mrmr_limit)]


def bpso(df: DataFrame, target: str, features: str = "features", candidate_limit: int | None = 150, sensitivity: float = 2.0, mrmr_limit: int = 50, particles: int | None = None, steps: int | None = None, alpha: float = 0.95, seed: int = 42, sample_rows: int | None = None, allow_empty: bool = False, stride: int = 1, w: float = 0.729, c1: float = 1.49445, c2: float = 1.49445, n_rounds: int = 1, save: str | None = None) -> list[int]:
    """Positions that the binary swarm selects, in n_rounds at most, each among what the one before selected, until that is stable."""
    df = strided(df, target, features, stride, seed)

    def once(among: list[int] | None) -> list[int]:
        cut = df if among is None else gather(df, among, features)
        short = shortlist(cut, target, features, candidate_limit, sensitivity, 150, mrmr_limit)
        size = particles or int(np.clip(0.3 * len(short), 20, 60))
        turns = steps or int(np.clip(0.4 * len(short), 15, 40))
        frames = packed(gather(cut, short, features), target, features, sample_rows=sample_rows, seed=seed)
        best, _ = swarm(evaluated(lambda masks, starts: binary_losses(frames, masks, alpha, starts)), len(short), size, turns, seed, w, c1, c2)
        frames.blocks.unpersist()
        chosen = [short[i] if among is None else among[short[i]] for i in np.flatnonzero(best > 0.5)]
        if not chosen and not allow_empty:
            raise ValueError("the swarm selected nothing")
        return chosen

    return rounds(once, n_rounds, save, df.sparkSession)


def mpso(df: DataFrame, target: str, dimensions: int = 5, features: str = "features", candidate_limit: int | None = 250, sensitivity: float = 2.0, mrmr_limit: int = 60, particles: int = 20, steps: int = 10, alpha: float = 0.9, weight: float = 0.2, seed: int = 42, sample_rows: int | None = None, stride: int = 1, w: float = 0.729, c1: float = 1.49445, c2: float = 1.49445, threshold: float = 0.5, n_rounds: int = 1) -> tuple[list[int], np.ndarray]:
    """Positions and the matrix (positions by dimensions) of mean-of-features weights; rounds as in bpso, among the features in use."""
    df = strided(df, target, features, stride, seed)
    last: tuple[list[int], np.ndarray] = ([], np.zeros((0, dimensions)))

    def once(among: list[int] | None) -> list[int]:
        nonlocal last
        cut = df if among is None else gather(df, among, features)
        short = shortlist(cut, target, features, candidate_limit, sensitivity, 250, mrmr_limit)
        frames = packed(gather(cut, short, features), target, features, sample_rows=sample_rows, seed=seed)
        best, _ = swarm(evaluated(lambda masks, starts: projection_losses(frames, masks, dimensions, alpha, weight, starts=starts), threshold), len(short) * dimensions, particles, steps, seed, w, c1, c2)
        frames.blocks.unpersist()
        chosen = (best.reshape(len(short), dimensions) > threshold).astype(float)
        last = ([p if among is None else among[p] for p in short], chosen / (chosen.sum(0) + 1e-12))
        return [p for p, used in zip(last[0], chosen.any(1), strict=True) if used]

    rounds(once, n_rounds)
    return last
