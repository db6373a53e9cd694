"""Cuts of a list of scores: knees, percentiles, outliers, cumulative shares.

A list of scores has one entry per feature or component, so it is small; the knee is found
on the driver, all other cuts are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knee(values: Sequence[float], first_x: float = 0.0, sensitivity: float = 1.0) -> tuple[float, float] | None:
    """(x, y) of the knee of a convex decreasing curve over first_x, first_x + 1, ...; None without one.

    Both axes are scaled to [0, 1] and the curve is turned over; knees are local maxima of
    its height over the diagonal, confirmed when the height falls below the maximum by more
    than sensitivity times the mean step of x.
    """
    y = np.asarray(values, float)
    if len(y) < 3 or not np.isfinite(y).all() or y.max() == y.min():
        return None
    x = np.linspace(0.0, 1.0, len(y))
    height = (y.max() - y) / (y.max() - y.min()) - x
    peaks = [i for i in range(1, len(y) - 1) if height[i] >= height[i - 1] and height[i] >= height[i + 1]]
    dips = {i for i in range(1, len(y) - 1) if height[i] <= height[i - 1] and height[i] <= height[i + 1]}
    if not peaks:
        return None
    at, threshold = None, 0.0
    for i in range(peaks[0], len(y)):
        if i in peaks:
            at, threshold = i, height[i] - sensitivity / (len(y) - 1)
        elif i in dips:
            threshold = 0.0
        if at is not None and i > at and height[i] < threshold:
            return first_x + at, float(y[at])
    return None


def without_outliers(scores: DataFrame, column: str, multiplier: float = 3.0) -> DataFrame:
    """Rows up to the third quartile plus multiplier times the interquartile range."""
    q = scores.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    limit = q.select((F.col("q")[1] + multiplier * (F.col("q")[1] - F.col("q")[0])).alias("_limit"))
    return scores.crossJoin(F.broadcast(limit)).where(F.col(column) <= F.col("_limit")).drop("_limit")


def without_insane(scores: DataFrame, column: str, times: float = 100.0) -> DataFrame:
    """Rows of at most times the median, all rows if the median is 0."""
    median = scores.agg(F.median(column).alias("_median"))
    return scores.crossJoin(F.broadcast(median)).where((F.col("_median") == 0) | (F.col(column) <= times * F.col("_median"))).drop("_median")


def above_percentile(scores: DataFrame, column: str, percent: float = 90.0) -> DataFrame:
    """Rows above the percentile, or above twice the median where there are ten rows or fewer."""
    limit = scores.agg(F.when(F.count(column) > 10, F.percentile(column, F.lit(percent / 100))).otherwise(2 * F.median(column)).alias("_limit"))
    return scores.crossJoin(F.broadcast(limit)).where(F.col(column) > F.col("_limit")).drop("_limit")


def variance_cut(scores: DataFrame, column: str = "variance", sensitivity: float = 1.0, multiplier: float = 3.0, percent: float = 90.0, least_clean: float = 0.5) -> DataFrame:
    """Features whose variance is above the knee of the sorted variances (outliers apart), or above the percentile without a knee."""
    rows = scores.count()
    clean = without_outliers(scores, column, multiplier)
    if clean.count() < least_clean * rows:
        clean = scores
    values = [r[0] for r in clean.select(column).orderBy(F.desc(column)).collect()]  # one number per feature
    found = knee(values, 0.0, sensitivity)
    return scores.where(F.col(column) > found[1]) if found else above_percentile(scores, column, percent)


def cut_by_knee(scores: DataFrame, column: str = "score", sensitivity: float = 1.0, first_x: float = 1.0, fallback: float | None = None) -> DataFrame:
    """Rows at or above the knee; without one those at or above the fallback (None: the 90th percentile)."""
    found = knee([r[0] for r in scores.select(column).orderBy(F.desc(column)).collect()], first_x, sensitivity)
    if found:
        return scores.where(F.col(column) >= found[1])
    if fallback is not None:
        return scores.where(F.col(column) >= fallback)
    limit = scores.agg(F.percentile(column, F.lit(0.9)).alias("_limit"))
    return scores.crossJoin(F.broadcast(limit)).where(F.col(column) >= F.col("_limit")).drop("_limit")


def cumulative_cut(values: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """values, largest first, with their running share, up to the first that reaches share."""
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.desc(column), "pos").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(column).over(ordered) / F.sum(column).over(everything)
    out = values.withColumn("running", running)
    return out.withColumn("_before", F.coalesce(F.lag("running").over(everything.orderBy(F.desc(column), "pos")), F.lit(0.0))).where(F.col("_before") < share).drop("_before")


def components_for(values: np.ndarray, share: float = 0.95) -> int:
    """The smallest number of leading values that reach share of their sum."""
    v = np.clip(np.asarray(values, float), 0, None)
    if v.sum() <= 0:
        return 0
    return int(np.searchsorted(np.cumsum(v) / v.sum(), share - 1e-12) + 1)
