"""Quantile bins and chi-squared scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.features import to_long
from framelens.operators.quantiles import quantiles
from framelens.operators.tables import head
from framelens.operators.tables import stride as every


def quantile_edges(df: DataFrame, bins: int = 5, features: str = "features", sample_rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """pos, edges: the distinct linearly interpolated quantiles of each feature, over all rows or the first sample_rows of them by order."""
    if sample_rows is not None:
        df = head(df, order, sample_rows)
    found = quantiles(df, [i / bins for i in range(bins + 1)], features)
    return found.select("pos", F.array_distinct("values").alias("edges"))


def binned(long: DataFrame, edges: DataFrame) -> DataFrame:
    """long with bin: intervals are closed on the right, the lowest edge belongs to the first; null outside."""
    joined = long.join(F.broadcast(edges), "pos")  # a row for each feature
    inside = (F.col("x") >= F.get("edges", F.lit(0))) & (F.col("x") <= F.get("edges", F.size("edges") - 1))
    below = F.size(F.filter("edges", lambda e: e < F.col("x")))
    return joined.withColumn("bin", F.when(inside, F.greatest(below - 1, F.lit(0)))).drop("edges")


def chi_squared(df: DataFrame, target: str, features: str = "features", bins: int = 5, stride: int = 1, key: Sequence[str] = (), order: Sequence[str] = (), sample_rows: int | None = None) -> DataFrame:
    """pos, score over the whole grid of bins and classes; constant features have no row.

    Edges are of all rows (or the first sample_rows by order); counts of every stride-th row of each
    trajectory (key, order), without an order of about every stride-th by digest of its values.
    """
    edges = quantile_edges(df, bins, features, sample_rows, order).where(F.size("edges") > 1)
    digest = F.pmod(F.xxhash64(target, features), F.lit(stride)) == 0
    counted = df if stride <= 1 else every(df, key, order, stride) if order else df.where(digest)
    long = to_long(counted, features, [target])
    observed = binned(long, edges).where("bin is not null").groupBy("pos", "bin", target).agg(F.count(F.lit(1)).alias("o"))
    # Dealt by feature once, so that the marginals need no further exchange; a feature has few bins and classes.
    observed = observed.repartition("pos")
    total = lambda *by: F.sum("o").over(Window.partitionBy(*by))
    cells = observed.withColumn("r", total("pos", "bin")).withColumn("c", total("pos", target)).withColumn("t", total("pos"))
    # Over the whole grid the expected counts add up to t, and so do the observed ones: the sum of
    # (o - e)^2 / e is that of o^2 / e, less t, to which empty cells add nothing.
    return cells.groupBy("pos").agg(F.greatest(F.sum(F.col("o") * F.col("o") * F.col("t") / (F.col("r") * F.col("c"))) - F.first("t"), F.lit(0.0)).alias("score"))
