"""Feature columns: names, positions, and the wide, long and array views of a frame table.

A frame table keeps one row per frame with its features in a single array column; wide and
long tables are views of it at the edges. (Thousands of columns would each be planned and
compiled; one array is not.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Columns that describe a frame and are never features.
METADATA = ("construct", "subconstruct", "replica", "frame_number", "time", "class", "global_cluster_id", "ground_truth")
#: What identifies a frame.
KEY = ("construct", "subconstruct", "replica", "frame_number")
#: Fixed value: the form of a pair's name.
PAIR_NAME = r"(?i)^RES(\d+)_(\d+)"

#: Positions up to which each is an expression of its own.
MANY = 256


def feature_columns(df: DataFrame, metadata: Sequence[str] = METADATA) -> list[str]:
    """Numeric columns that are not metadata, in order, each once."""
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in metadata]
    return list(dict.fromkeys(names))


def to_array(df: DataFrame, columns: Sequence[str], features: str = "features") -> DataFrame:
    """The wide view as a frame table: columns gathered in one array of doubles."""
    gathered = F.array(*[F.col(c).cast("double") for c in columns]).alias(features)
    return df.select(*[c for c in df.columns if c not in columns], gathered)


def to_long(df: DataFrame, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """keep, pos, x: one row per frame and feature; NaN becomes null."""
    out = df.select(*keep, F.posexplode(features).alias("pos", "_x"))
    x = F.col("_x").cast("double")
    return out.select(*keep, "pos", F.when(~F.isnan(x), x).alias("x"))


def to_wide(df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """One column per name, in the order of the array."""
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.get(features, F.lit(i)).alias(n) for i, n in enumerate(names)])


def gather(df: DataFrame, positions: Sequence[int], features: str = "features") -> DataFrame:
    """The array cut down to the given positions, in their order; other columns stay."""
    at = [int(p) for p in positions]
    if len(at) <= MANY or len(set(at)) < len(at):
        return df.withColumn(features, F.array(*[F.get(features, F.lit(p)) for p in at]) if at else F.slice(features, 1, 0))
    # Thousands of positions: one pass over the array, which gives each value its place, in place of an expression for each.
    places = [-1] * (max(at) + 1)
    for k, p in enumerate(at):
        places[p] = k
    wanted = F.from_json(F.lit(str(places)), "array<int>")
    placed = F.transform(features, lambda x, i: F.struct(F.coalesce(F.get(wanted, i), F.lit(-1)).alias("k"), x.alias("x")))
    kept = F.filter(placed, lambda s: s["k"] >= 0)
    return df.withColumn(features, F.transform(kept if at == sorted(at) else F.array_sort(kept), lambda s: s["x"]))


def pair_names(residues: DataFrame, column: str = "residue") -> DataFrame:
    """pos, name, res_i, res_j of all pairs i < j of distinct residues, in condensed row-major order."""
    distinct = residues.select(F.col(column).cast("int").alias("r")).distinct()
    pairs = distinct.select(F.col("r").alias("res_i")).join(distinct.select(F.col("r").alias("res_j")), F.col("res_i") < F.col("res_j"))
    # The position in closed form, so that the pairs need no global order.
    ordered = Window.partitionBy(F.lit(0)).orderBy("r")
    rank = distinct.withColumn("k", F.row_number().over(ordered) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    a = rank.select(F.col("r").alias("res_i"), F.col("k").alias("i"), "n")
    b = rank.select(F.col("r").alias("res_j"), F.col("k").alias("j"))
    pos = condensed_position(F.col("i"), F.col("j"), F.col("n"))
    return pairs.join(a, "res_i").join(b, "res_j").select(pos.alias("pos"), F.concat(F.lit("RES"), "res_i", F.lit("_"), "res_j").alias("name"), "res_i", "res_j")


def condensed_position(i: Column, j: Column, n: Column) -> Column:
    """Where the pair i < j of n members stands in a condensed upper triangle."""
    return (F.floor(i * (2 * n - i - 1) / 2) + j - i - 1).cast("int")


def parse_pair(name: str = "name") -> list[Column]:
    """res_i and res_j of a pair name, null if it is none."""
    part = lambda k: F.regexp_extract(name, PAIR_NAME, k)
    return [F.when(part(k) != "", part(k).cast("int")).alias(f"res_{c}") for k, c in ((1, "i"), (2, "j"))]


def square_form(pairs: DataFrame, value: str = "x") -> DataFrame:
    """i, j and the value both ways round, with zeros on the diagonal, from i < j."""
    both = pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value))
    ends = pairs.select("i").union(pairs.select("j")).distinct()
    return both.unionByName(ends.select("i", F.col("i").alias("j"), F.lit(0.0).alias(value)))


def pairwise_distances(points: DataFrame, key: Sequence[str], member: str, coordinates: Sequence[str]) -> DataFrame:
    """key, i, j, distance for all members i < j of a frame. Frames, not pairs, are what grows."""
    side = lambda end: points.select(*key, F.col(member).alias(end), *[F.col(c).alias(f"_{c}_{end}") for c in coordinates])
    both = side("i").join(side("j"), list(key)).where("i < j")
    square = sum((F.pow(F.col(f"_{c}_i") - F.col(f"_{c}_j"), 2) for c in coordinates), F.lit(0.0))
    return both.select(*key, "i", "j", F.sqrt(square).alias("distance"))


def mask_pairs(df: DataFrame, masked: DataFrame, features: str = "features") -> DataFrame:
    """Null at the positions (pos) of masked, a table of the width of a frame at most."""
    flags = masked.select(F.collect_set("pos").alias("_masked"))
    out = df.crossJoin(F.broadcast(flags))  # one row
    return out.withColumn(features, F.transform(features, lambda x, i: F.when(~F.array_contains("_masked", i), x))).drop("_masked")
