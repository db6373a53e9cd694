"""Linear reductions of frame tables: PCA and four discriminant analyses.

Spark adds up class means and class scatters (centred on those means, so nothing cancels);
what reaches the driver is a few matrices as wide as the selected features. The fitted
matrix is sent to the data and applied batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.grams import TILE, leading_components, rows_of, tiles_of
from framelens.operators.moments import class_moments
from framelens.operators.thresholds import components_for

#: Matrices wider than this are refused: select features first.
WIDEST = 4096


@dataclass
class Scatter:
    classes: list
    n: np.ndarray
    means: np.ndarray
    scatters: np.ndarray

    @property
    def total(self) -> float:
        return float(self.n.sum())

    @property
    def grand(self) -> np.ndarray:
        return self.n @ self.means / self.total

    @property
    def within(self) -> np.ndarray:
        return self.scatters.sum(0)

    @property
    def between(self) -> np.ndarray:
        d = self.means - self.grand
        return (d * self.n[:, None]).T @ d

    def scaled(self, scale: np.ndarray, center: bool = False) -> Scatter:
        """The statistics of features divided by scale."""
        means = self.means - self.grand if center else self.means
        return Scatter(self.classes, self.n, means / scale, self.scatters / scale[:, None] / scale[None, :])

    @property
    def norms(self) -> np.ndarray:
        """Euclidean norms of the features over all rows; 1 for zero features."""
        squares = np.diagonal(self.scatters, axis1=1, axis2=2).sum(0) + self.n @ self.means**2
        return np.where(squares > 0, np.sqrt(np.maximum(squares, 0)), 1.0)


def scatter(df: DataFrame, target: str, features: str = "features") -> Scatter:
    """Class counts, means and scatters; rows without a class are left out."""
    df = df.where(F.col(target).isNotNull()).select(target, F.col(features).alias("x"))
    stats = class_moments(df, target, "x").collect()  # classes times features numbers
    if not stats:
        raise ValueError("no rows with a class")
    classes = sorted({r[target] for r in stats})
    width = 1 + max(r["pos"] for r in stats)
    if width > WIDEST:
        raise ValueError(f"{width} features: select at most {WIDEST} before taking their scatter")
    n, means = np.zeros(len(classes)), np.zeros((len(classes), width))
    for r in stats:
        c = classes.index(r[target])
        n[c], means[c, r["pos"]] = max(n[c], r["n"]), r["mean"] if r["mean"] is not None else 0.0
    edge = range(0, width, TILE)

    def products(own: pa.Array, column: pa.Array) -> dict[tuple[int, int], np.ndarray]:
        number = pc.index_in(own, pa.array(classes, own.type)).to_numpy(zero_copy_only=False)
        x = np.nan_to_num(rows_of(column) - means[number])
        out = {}
        for c in np.unique(number).tolist():
            part = x[number == c]
            # The lower triangle mirrors the upper one.
            out |= {(c, i * len(edge) + j): part[:, a : a + TILE].T @ part[:, b : b + TILE] for i, a in enumerate(edge) for j, b in enumerate(edge) if i <= j}
        return out

    scatters = np.zeros((len(classes), width, width))
    for r in tiles_of(df.where("x is not null"), [target, "x"], products).collect():  # classes times width squared numbers
        a, b = (TILE * k for k in divmod(r["j"], len(edge)))
        tile = np.frombuffer(r["tile"], float).reshape(min(TILE, width - a), -1)
        scatters[r["i"], a : a + TILE, b : b + TILE] = tile
        scatters[r["i"], b : b + TILE, a : a + TILE] = tile.T
    return Scatter(classes, n, means, scatters)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their entry of largest size is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def project(df: DataFrame, matrix: np.ndarray, shift: np.ndarray | None = None, features: str = "features", out: str = "proj") -> DataFrame:
    """df with the array of components in place of its features."""
    shift = np.zeros(len(matrix)) if shift is None else shift

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        missing = np.asarray(x.is_null())
        if missing.all():
            return pa.nulls(len(x), pa.list_(pa.float64()))
        out = (rows_of(x.drop_null()) - shift) @ matrix
        ends = np.concatenate([[0], np.cumsum(~missing)]).astype(np.int32) * matrix.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(missing))

    done = df.withColumn(out, apply(features))
    return done if out == features else done.drop(features)


def _descending(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values)
    return values[order], vectors[:, order]


def _capped(s: Scatter, k: int | None, values: np.ndarray, least: int = 1, ranks: int | None = None) -> int:
    """Explicit numbers are held to the features and to ranks (classes - 1); None means 95 % of the positive values."""
    if k is not None:
        return min(k, len(values), len(s.classes) - 1 if ranks is None else ranks)
    return max(least, min(components_for(values), len(values)))


def _two_classes(s: Scatter) -> None:
    if len(s.classes) < 2:
        raise ValueError("at least two classes are needed")


@dataclass
class Reduction:
    matrix: np.ndarray
    values: np.ndarray
    shift: np.ndarray | None = None

    def __call__(self, df: DataFrame, features: str = "features", out: str = "proj") -> DataFrame:
        return project(df, self.matrix, self.shift, features, out)


def fit_pca(s: Scatter, k: int | None = 2, whiten: bool = False) -> Reduction:
    values, vectors = _descending(*np.linalg.eigh((s.within + s.between) / max(s.total - 1, 1)))
    n = min(k, len(values)) if k is not None else components_for(values)
    matrix = signed(vectors[:, :n])
    if whiten:
        matrix = matrix / np.sqrt(np.maximum(values[:n], 1e-12))
    return Reduction(matrix, values[:n], s.grand)


def fit_wide_pca(df: DataFrame, features: str = "features", k: int | None = 2, whiten: bool = False, **options) -> Reduction:
    """Principal components of any number of features, without their scatter; k None means 95 % of the variance."""
    values, vectors, means, _ = leading_components(df, features, k or 1, 0.95 if k is None else None, **options)
    matrix = signed(vectors)
    if whiten:
        matrix = matrix / np.sqrt(np.maximum(values, 1e-12))
    return Reduction(matrix, values, means)


def fit_flda(s: Scatter, k: int | None = 2, mode: str = "between", regularization: float = 1e-6) -> Reduction:
    """Leading directions of the class means; mode "classical" weighs them by the inverse within-class scatter."""
    _two_classes(s)
    if mode == "classical":
        values, vectors = generalized(s.between, s.within + regularization * np.eye(len(s.between)))
    else:
        values, vectors = _descending(*np.linalg.eigh(s.between))
    values, vectors = values[: len(s.classes) - 1], vectors[:, : len(s.classes) - 1]
    n = _capped(s, k, values)
    return Reduction(signed(vectors[:, :n]), values[:n])


def generalized(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of a v = l b v for symmetric a and positive definite b, largest first."""
    root = np.linalg.cholesky(b)
    inverse = np.linalg.inv(root)
    values, vectors = _descending(*np.linalg.eigh(inverse @ a @ inverse.T))
    return values, inverse.T @ vectors


def _inverse(m: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


def fit_mhlda(s: Scatter, k: int | None = 2, regularization: float = 1e-4) -> Reduction:
    """Up to as many components as features; those beyond classes - 1 have value 0 and no direction of their own.

    Classes of one row count neither within nor between; where the problem cannot be solved, the leading right singular vectors of the rows.
    """
    _two_classes(s)
    eye, some = np.eye(s.means.shape[1]), s.n >= 2
    within = sum((n / s.total * _inverse(m + regularization * eye) for n, m in zip(s.n[some], s.scatters[some], strict=True)), 0 * eye)
    d = s.means[some] - s.grand
    try:
        values, vectors = generalized((d * s.n[some, None]).T @ d, within + 1e-9 * eye)
    except np.linalg.LinAlgError:
        values, vectors = _descending(*np.linalg.eigh(s.within + s.between + s.total * np.outer(s.grand, s.grand)))
    n = _capped(s, k, np.where(values > 0, values, 0.0), 2, len(values))
    return Reduction(signed(vectors[:, :n] / np.linalg.norm(vectors[:, :n], axis=0)), values[:n])


def descend(w: np.ndarray, within: np.ndarray, deltas: np.ndarray, weights: np.ndarray, rate: float, steps: int, patience: int, tolerance: float, epsilon: float, every: int, least: float = 0.0) -> np.ndarray:
    """Gradient descent of the weighted sum of ratios of within-class to pairwise spread, kept near orthonormal matrices.

    deltas: differences of class means, one row a pair; pairs whose spread is at most least
    are left out. The gradient's norm is held to 1; every some steps w is made orthonormal.
    """
    last, calm = None, 0
    for step in range(steps):
        sw = within @ w
        a = float((w * sw).sum())
        seen = deltas @ w
        spread = (seen * seen).sum(1)
        own = np.where(spread > least, weights, 0.0) if least else weights
        b = spread + epsilon
        value = float((own * a / b).sum())
        slope = 2 * sw * (own / b).sum() - 2 * a * deltas.T @ (seen * (own / b**2)[:, None])
        size = np.linalg.norm(slope)
        if size > 1:
            slope = slope / size
        w = w - rate * (slope - w @ slope.T @ w)
        calm = calm + 1 if last is not None and abs(value - last) < tolerance else 0
        if calm >= patience:
            break
        last = value
        if step % every == 0:
            w = np.linalg.qr(w)[0]
    return w


def _pairwise(s: Scatter) -> tuple[np.ndarray, np.ndarray]:
    g, h = np.triu_indices(len(s.classes), 1)
    return s.means[g] - s.means[h], s.n[g] * s.n[h]


def _heteroscedastic(s: Scatter, within, start, k, normalize, center, rate, steps, patience, tolerance, epsilon, every, least=0.0) -> Reduction:
    _two_classes(s)
    scale = s.norms if normalize else np.ones(s.means.shape[1])
    shift = s.grand if center else None
    t = s.scaled(scale, center)
    deltas, weights = _pairwise(t)
    sw = within(t)
    # The sum over pairs of classes of n_g n_h d d' is the number of rows times the scatter between classes.
    values, vectors = start(t, sw, t.total * t.between)
    n = _capped(s, k, np.clip(values, 0, None))
    w = descend(vectors[:, :n], sw, deltas, weights, rate, steps, patience, tolerance, epsilon, every, least)
    return Reduction(signed(w) / scale[:, None], values[:n], shift)


def fit_zhlda(s: Scatter, k: int | None = 2, rate: float = 1e-4, steps: int = 2000, patience: int = 50, tolerance: float = 1e-6, normalize: bool = True, center: bool = False) -> Reduction:
    def start(t, sw, between):
        values, vectors = np.linalg.eig(np.linalg.solve(sw + 1e-6 * np.eye(len(sw)), between))
        order = np.argsort(-np.abs(values))
        return np.abs(values[order]), np.real(vectors[:, order])

    return _heteroscedastic(s, lambda t: t.within, start, k, normalize, center, rate, steps, patience, tolerance, 1e-8, 20, 1e-12)


def fit_gdhlda(s: Scatter, k: int | None = 2, rate: float = 1e-4, steps: int = 2000, patience: int = 50, tolerance: float = 1e-6, normalize: bool = True, center: bool = False) -> Reduction:
    def within(t):
        eye = np.eye(t.means.shape[1])
        return sum(n / t.total * np.linalg.pinv(m + 1e-7 * eye) for n, m in zip(t.n, t.scatters, strict=True))

    return _heteroscedastic(s, within, lambda t, sw, between: _descending(*np.linalg.eigh(between)), k, normalize, center, rate, steps, patience, tolerance, 1e-10, 25)


#: Reductions by name.
FITS = {"pca": fit_pca, "flda": fit_flda, "mhlda": fit_mhlda, "zhlda": fit_zhlda, "gdhlda": fit_gdhlda}


def correlation(s: Scatter) -> np.ndarray:
    """Absolute correlations of the features over all rows; 0 where undefined."""
    total = s.within + s.between
    d = np.sqrt(np.diag(total))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.abs(np.nan_to_num(total / d[:, None] / d[None, :], posinf=0.0, neginf=0.0))


def wide_projection(df: DataFrame, count: int, prefix: str = "LD", proj: str = "proj") -> DataFrame:
    """One column per component, named prefix1, prefix2, ..."""
    return df.select(*[c for c in df.columns if c != proj], *[F.get(proj, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(count)])
