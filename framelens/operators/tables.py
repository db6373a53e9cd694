"""Filters, joins, composition tables and leaderboards over frame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.operators import grams


def by_names(df: DataFrame, **wanted: Sequence[str] | None) -> DataFrame:
    """Rows whose columns are among the given names; None stands for all. Reaches the scan as a partition or pushed filter, in the frames source too."""
    for column, names in wanted.items():
        if names is not None:
            df = df.where(F.col(column).isin(*names))
    return df


def from_frame(df: DataFrame, least: int, column: str = "frame_number") -> DataFrame:
    return df.where(F.col(column) >= least) if least > 0 else df


def catalogue(df: DataFrame, parent: str, child: str) -> DataFrame:
    """parent and the sorted names of its children."""
    return df.groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias("members"))


def boundary_clip(pairs: DataFrame, n_edge: int = 3) -> DataFrame:
    """Pairs (res_i, res_j) of which neither is among the n_edge residues at an end or on either side of a gap.

    0 clips nothing. Residues are as many as a frame has members.
    """
    if n_edge <= 0:
        return pairs
    residues = pairs.select(F.col("res_i").alias("r")).union(pairs.select("res_j")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("r")
    islands = residues.withColumn("_new", F.coalesce((F.col("r") - F.lag("r").over(order) > 1).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(order))
    # An island is cut at both ends: its ends are gaps or the ends of the chain.
    up = F.row_number().over(Window.partitionBy("_island").orderBy("r"))
    down = F.row_number().over(Window.partitionBy("_island").orderBy(F.desc("r")))
    gone = islands.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= n_edge) | (F.col("_d") <= n_edge)).select("r")
    return pairs.join(gone, F.col("res_i") == F.col("r"), "left_anti").join(gone, F.col("res_j") == F.col("r"), "left_anti")


def stride(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Every k-th frame of each trajectory, the first included."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where((F.col("_n") - 1) % k == 0).drop("_n")


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def random_sample(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most n rows, evenly at random by a digest of seed and key (all columns), the same again for the same rows and seed."""
    key = list(key or df.columns)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    return df.orderBy(digest, *key).limit(n)


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df


def with_times(frames: DataFrame, times: DataFrame, key: Sequence[str]) -> DataFrame:
    """frames with time from times (key, idx, time), where idx counts from 0 and frame_number from 1."""
    placed = times.select(*key, (F.col("idx") + 1).alias("frame_number"), "time")
    return frames.join(placed, [*key, "frame_number"], "left")


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], first: Column | int = 1) -> DataFrame:
    """frame_number counts up within each trajectory."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("frame_number", (n + first).cast("long"))


def composition(df: DataFrame, cluster: str, target: str) -> DataFrame:
    """cluster, target, n, percent (of the cluster): the long form of a crosstab."""
    counts = df.groupBy(cluster, target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))


def crosstab(df: DataFrame, cluster: str, target: str, classes: Sequence) -> DataFrame:
    """One row per cluster, one column n_<class> for each of the given classes."""
    return df.groupBy(cluster).agg(*[F.count_if(F.col(target) == F.lit(c)).alias(f"n_{c}") for c in classes])


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, rows, least (rows of the smallest class)."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.count(target).alias("classes"), F.sum("n").alias("rows"), F.min("n").alias("least"))


def correlations(df: DataFrame, columns: Sequence[str], others: Sequence[str]) -> DataFrame:
    """feature, component, r of every pair of columns, each over the rows that have both; undefined ones are 0."""
    r = grams.correlations(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("a"), F.array(*[F.col(c).cast("double") for c in others]).alias("b")), "a", "b")
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.col(at) + 1)
    return r.select(named(columns, "i").alias("feature"), named(others, "j").alias("component"), "r")


def top_contributions(r: DataFrame, k: int, by_magnitude: bool = True) -> DataFrame:
    """The k features that correlate most with each component, with their rank."""
    order = F.desc(F.abs("r")) if by_magnitude else F.desc("r")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(order, "feature"))
    return r.withColumn("rank", rank).where(F.col("rank") <= k)


def histogram(df: DataFrame, column: str, by: str, bins: int) -> DataFrame:
    """by, bin, density over the common range of the column."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    rows = df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(column) - F.col("_a")) / width), F.lit(bins - 1)).cast("int")).withColumn("_w", width)
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_w").alias("_w"))
    return counts.select(by, "bin", (F.col("n") / (F.sum("n").over(Window.partitionBy(by)) * F.col("_w"))).alias("density"))


def leaderboard(scores: DataFrame, name: str = "pipeline", score: str = "separability") -> DataFrame:
    """scores with rank (equal scores share it) and share of the sum; one row per pipeline."""
    everything = Window.partitionBy(F.lit(0))
    return scores.withColumn("rank", F.rank().over(everything.orderBy(F.desc(score)))).withColumn("share", F.col(score) / F.sum(score).over(everything))


def best(scores: DataFrame, by: str, value: str, least: bool = True) -> DataFrame:
    """One row: the entry of by with the least (or greatest) value."""
    pick = F.min_by if least else F.max_by
    return scores.agg(pick(by, F.struct(value, by) if least else F.struct(F.col(value), -F.col(by))).alias(by))


def mapped_class(df: DataFrame, keys: Sequence[str], classes: dict[tuple, int], name: str = "class") -> DataFrame:
    """df with the class of its keys, 0 where unknown."""
    case = F.lit(0)
    for values, number in classes.items():
        hit = F.lit(True)
        for k, v in zip(keys, values, strict=True):
            hit = hit & F.col(k).eqNullSafe(F.lit(v))
        case = F.when(hit, F.lit(number)).otherwise(case)
    return df.withColumn(name, case)


def block_labels(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int, classes: int, first: int = 0) -> DataFrame:
    """Labels by blocks of consecutive rows within a trajectory, starting over after the last class."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("class", (F.floor(n / size) % classes + first).cast("int"))


def unioned(parts: Sequence[DataFrame], labels: Sequence | None = None, name: str = "class") -> DataFrame:
    """All rows of all parts (UNION ALL), each with its label if labels are given."""
    tagged = [p.withColumn(name, F.lit(v)) for p, v in zip(parts, labels, strict=True)] if labels is not None else list(parts)
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out


FRAME_KEY = ("construct", "subconstruct", "replica", "frame_number")


def aligned(left: DataFrame, right: DataFrame, key: Sequence[str] = FRAME_KEY) -> DataFrame:
    """Rows of left beside the rows of right of the same frame; columns of right that left has too are left out."""
    own = [c for c in right.columns if c in key or c not in left.columns]
    return left.join(right.select(*own), [*key])


def with_column_of(df: DataFrame, other: DataFrame, column: str, key: Sequence[str] = FRAME_KEY) -> DataFrame:
    """df with a column of other by frame, null where other has no such frame; other has a frame once."""
    return df.drop(column).join(other.select(*key, column), [*key], "left")


def among(df: DataFrame, chosen: DataFrame, key: Sequence[str] = FRAME_KEY) -> DataFrame:
    """Rows of df whose key is in chosen."""
    return df.join(chosen.select(*key), [*key], "left_semi")


def not_among(df: DataFrame, gone: DataFrame, key: Sequence[str] = FRAME_KEY) -> DataFrame:
    """Rows of df whose key is not in gone."""
    return df.join(gone.select(*key), [*key], "left_anti")


def class_pairs(df: DataFrame, target: str) -> DataFrame:
    """a, b: every pair of different classes once, the smaller first."""
    classes = df.select(target).where(F.col(target).isNotNull()).distinct()
    return classes.select(F.col(target).alias("a")).join(classes.select(F.col(target).alias("b")), F.col("a") < F.col("b"))


def products(first: DataFrame, second: DataFrame, separator: str = " | ") -> DataFrame:
    """Every combination of two small lists (one column each), with its name."""
    a, b = first.columns[0], second.columns[0]
    return first.distinct().crossJoin(F.broadcast(second.distinct())).withColumn("name", F.concat(a, F.lit(separator), b))


def distinct_in_order(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """by and the different values of each group, in the order in which they come first, equal places by value."""
    firsts = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v"))))
    return firsts.groupBy(*by).agg(F.transform(listed, lambda x: x["_v"]).alias(out))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """The different rows of all parts (UNION)."""
    return unioned(parts).distinct()


def ranked_grid(df: DataFrame, parameters: Sequence[str], value: str) -> DataFrame:
    """Mean of value and rows for every combination of parameters, the best first by rank; one row per combination."""
    rows = df.groupBy(*parameters).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), *parameters)))
