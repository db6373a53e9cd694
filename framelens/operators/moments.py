"""Moments per class and feature, and what is a function of them: variance, scaling, Fisher scores, separability.

All of them are one aggregation of the long view by (class, position) with partial sums. The
built-in variance merges means and squared deviations pairwise, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.features import to_long


def class_moments(df: DataFrame, target: str, features: str = "features") -> DataFrame:
    """target, pos, n, mean, ss (sum of squared deviations from the class mean)."""
    long = to_long(df, features, [target])
    out = long.groupBy(target, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    return out.select(target, "pos", "n", "mean", (F.col("v") * F.col("n")).alias("ss"))


def variances(df: DataFrame, features: str = "features") -> DataFrame:
    """pos, n, mean, variance (of the population)."""
    return to_long(df, features).groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def _over_classes(moments: DataFrame) -> DataFrame:
    """Adds the mean over all classes as grand."""
    all_ = Window.partitionBy("pos")
    grand = F.sum(F.col("n") * F.col("mean")).over(all_) / F.sum("n").over(all_)
    return moments.withColumn("grand", grand)


def fisher_pooled_samples(moments: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """pos, score: between over within, the within part weighting sample variances by n; classes of one are left out."""
    used = _over_classes(moments).where("n >= 2")
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))
    within = F.sum(F.col("n") * F.col("ss") / (F.col("n") - 1))
    return used.groupBy("pos").agg((between / (within + epsilon)).alias("score"))


def fisher_scatter(moments: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """pos, score: between-class over within-class scatter."""
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))
    return _over_classes(moments).groupBy("pos").agg((between / (F.sum(F.greatest("ss", F.lit(0.0))) + epsilon)).alias("score"))


def fisher_laplacian(moments: DataFrame) -> DataFrame:
    """pos, score in the graph-Laplacian form, whose closed form is between over within; a constant feature is divided by 10,000."""
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))
    sums = _over_classes(moments).groupBy("pos").agg(between.alias("b"), F.sum("ss").alias("w"))
    return sums.select("pos", F.when(F.col("b") + F.col("w") < 1e-12, F.col("b") / 10000.0).otherwise(F.col("b") / F.col("w")).alias("score"))


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """scores with rank, largest first, ties by position. One row per feature."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), "pos")))


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(score), "pos").limit(k)


def separability(df: DataFrame, target: str, features: str = "features", epsilon: float = 1e-9) -> DataFrame:
    """One row: separability pooled over all components of an array."""
    m = _over_classes(class_moments(df, target, features))
    return m.agg((F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)) / (F.sum("ss") + epsilon)).alias("separability"))


def component_separability(df: DataFrame, target: str, features: str = "features", epsilon: float = 1e-9) -> DataFrame:
    """pos, separability and share (of the sum over components)."""
    m = fisher_scatter(class_moments(df, target, features), epsilon).withColumnRenamed("score", "separability")
    return m.withColumn("share", F.col("separability") / F.sum("separability").over(Window.partitionBy(F.lit(0))))


def _arrays(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics by position as one row of arrays, as wide as a frame."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return stats.agg(ordered.alias("_s")).select(*[F.col(f"_s.{c}").alias(f"_{c}") for c in columns])


def _scaled(df: DataFrame, stats: DataFrame, features: str, shift: Column, scale: Column) -> DataFrame:
    one = _arrays(stats.select("pos", shift.alias("shift"), scale.alias("scale")), ["shift", "scale"])
    joined = df.crossJoin(F.broadcast(one))  # one row
    z = F.transform(features, lambda x, i: (x.cast("double") - F.get("_shift", i)) / F.get("_scale", i))
    return joined.withColumn(features, z).drop("_shift", "_scale")


def standard_scaled(df: DataFrame, features: str = "features", sample: bool = True) -> DataFrame:
    """Features less their mean over their deviation (of the sample or the population); constant ones become 0."""
    kind = F.stddev_samp if sample else F.stddev_pop
    stats = to_long(df, features).groupBy("pos").agg(F.avg("x").alias("m"), kind("x").alias("s"))
    return _scaled(df, stats, features, F.col("m"), F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)))


def min_max_scaled(df: DataFrame, features: str = "features", epsilon: float | None = None) -> DataFrame:
    """Features in [0, 1] by their global range; a range of 0 counts as 1, or epsilon is added to all."""
    stats = to_long(df, features).groupBy("pos").agg(F.min("x").alias("a"), (F.max("x") - F.min("x")).alias("r"))
    scale = F.when(F.col("r") > 0, F.col("r")).otherwise(F.lit(1.0)) if epsilon is None else F.col("r") + epsilon
    return _scaled(df, stats, features, F.col("a"), scale)


def l2_scaled(df: DataFrame, features: str = "features") -> DataFrame:
    """Features over their Euclidean norm over all frames."""
    stats = to_long(df, features).groupBy("pos").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
    return _scaled(df, stats, features, F.lit(0.0), F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)))
