"""Exact quantiles of every feature by distributed selection.

A rank is searched in an interval of values, which is cut into cells: tasks count the values in
each cell and note its least and greatest one, the counts are added up, and the rank's cell is
the next interval. The search ends where a cell holds a single value. Cells divide the order
of the doubles (their bits, read as an integer), so a pass over the data narrows an interval
by the number of cells whatever the scale and skew of the values, and 64 bits bound the passes.

What a task or the driver holds is features times ranks times cells, never values; the number
of cells shrinks as the features grow, so that this stays below ``STATE``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.features import to_long

#: Cells of all intervals together, about, and of one interval at most and at least.
STATE = 1 << 22
MOST_CELLS, LEAST_CELLS = 1024, 16
_SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles x; both zeros are one."""
    bits = (np.asarray(x, float) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def doubles(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys & _SIGN, keys & ~_SIGN, ~keys).view(float)


def _cells(at: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray, cells: int):
    """Counts and extremes of the cells of intervals from low to high of features at, which ascend."""
    by_feature = np.searchsorted(at, np.arange(int(at.max()) + 2)) if len(at) else np.zeros(1, int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(at), cells), np.int64)
        least, most = np.full((len(at), cells), ~np.uint64(0)), np.zeros((len(at), cells), np.uint64)
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            same = len(sizes) > 0 and (sizes == sizes[0]).all()
            for p in np.unique(at).tolist():
                x = values[p :: sizes[0]] if same and sizes[0] > p else values[place == p]
                keys = ordered(x[~np.isnan(x)])
                for k in range(by_feature[p], by_feature[p + 1]):
                    own = keys[(keys >= low[k]) & (keys <= high[k])]
                    cell = ((own - low[k]) // width[k]).astype(np.int64)
                    n[k] += np.bincount(cell, minlength=cells)
                    np.minimum.at(least[k], cell, own)
                    np.maximum.at(most[k], cell, own)
        k, c = np.nonzero(n)
        columns = [k.astype(np.int32), c.astype(np.int32), n[k, c], least[k, c].view(np.int64), most[k, c].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["k", "cell", "n", "least", "most"])

    return count


def order_statistics(df: DataFrame, features: str, at: np.ndarray, ranks: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The values of given ranks (from 0) of features at, from the extremes of those features."""
    low, high, rank = ordered(least), ordered(most), ranks.astype(np.int64)
    at = np.asarray(at)
    data = df.where(F.col(features).isNotNull()).select(features)
    while len(open_ := np.flatnonzero(low < high)):
        # Ranks that share an interval are searched together; intervals stand in order of their feature.
        keys, of = np.unique(np.stack([at[open_].astype(np.uint64), low[open_], high[open_]], 1), axis=0, return_inverse=True)
        of = of.ravel()
        own_at, own_low, own_high = keys[:, 0].astype(np.int64), keys[:, 1], keys[:, 2]
        cells = int(np.clip(STATE // len(keys), LEAST_CELLS, MOST_CELLS))
        width = (own_high - own_low) // np.uint64(cells) + np.uint64(1)
        counted = data.mapInArrow(_cells(own_at, own_low, own_high, width, cells), "k int, cell int, n long, least long, most long")
        # Extremes are unsigned; the top bit is turned so that Spark compares them as they are.
        turned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        summed = counted.groupBy("k", "cell").agg(F.sum("n").alias("n"), F.min(turned("least")).alias("least"), F.max(turned("most")).alias("most"))
        wanted = df.sparkSession.createDataFrame([(int(k), int(i), int(r)) for k, i, r in zip(of, open_, rank[open_], strict=True)], "k int, i int, r long")
        running = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("cell")))
        found = running.join(F.broadcast(wanted), "k").where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("n") <= F.col("r")))  # a row for each rank
        for r in found.select("i", (F.col("r") - F.col("upto") + F.col("n")).alias("r"), "least", "most").collect():
            rank[r["i"]] = r["r"]
            low[r["i"]], high[r["i"]] = (np.uint64(r[c] + (1 << 63)) for c in ("least", "most"))
    return doubles(low)


def quantiles(df: DataFrame, shares: Sequence[float], features: str = "features") -> DataFrame:
    """pos, values: the linearly interpolated quantiles of each feature over all rows; null and NaN count as absent."""
    stats = to_long(df, features).where("x is not null").groupBy("pos").agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("pos").collect()  # a row for each feature
    spark = df.sparkSession
    if not stats:
        return spark.createDataFrame([], "pos int, values array<double>")
    pos, n, a, b = (np.array([r[c] for r in stats]) for c in ("pos", "n", "a", "b"))
    exact = (n[:, None] - 1) * np.asarray(shares, float)
    below = np.floor(exact).astype(np.int64)
    ranks = np.stack([below, np.minimum(below + 1, n[:, None] - 1)], 2)
    flat = lambda v: np.repeat(v, ranks.shape[1] * 2)
    values = order_statistics(df, features, flat(pos), ranks.ravel(), flat(a).astype(float), flat(b).astype(float)).reshape(ranks.shape)
    low, high, part = values[..., 0], values[..., 1], exact - below
    with np.errstate(invalid="ignore", over="ignore"):
        # Where nothing is to be added nothing is, so that infinite values stay.
        out = np.where((part > 0) & (high > low), low + (high - low) * part, low)
    return spark.createDataFrame([(int(p), v) for p, v in zip(pos, out.tolist(), strict=True)], "pos int, values array<double>")
