"""Hard-negative mining by exact integer inner products.

Vectors become integers; the score of a row for an anchor is their inner product. An anchor's
positives are its best rows of the same label; for each of them the best rows of other labels
are returned whose score lies in a window below the positive's.

Anchors are dealt to blocks and all rows to slices, both by a digest of the row, so that no
label, vector or id can fill one of them. A cell is a block with a slice: its anchors are read
first, then its rows pass in tiles. Anchors times tile is a product of int64 matrices by
Strassen's recursion (zero padding to even sides, exact additions), so a task holds one
block and one tile. A cell keeps the best of every anchor in a heap of fixed size; heaps of
all cells are merged by a grouped limit. Two passes: positives first, then their windows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component,
take no part. A row is no partner of an anchor of its own id; rows that repeat an id otherwise
take part each. Vectors of unequal length count as padded with zeros. Components beyond 64
bits are held to them, scores are exact modulo 2^64. Ties go to the smaller id. Anchors
without positives or negatives give no rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import read_table, stored

#: Anchors of a block, rows of a slice, and rows of a tile, about.
ANCHORS, ROWS, TILE = 4096, 16_384, 512
#: Sides of a product from which it is no longer split.
LEAF = 32
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exact modulo 2^64, by seven products of half the sides."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = (np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) for x in (a, b))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def vectors(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows of one width, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    width = max(anchors.shape[1], rows.shape[1])
    wide = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows)]
    return strassen(wide[0], np.ascontiguousarray(wide[1].T))


class Heaps:
    """The best (score, id) pairs of any number of owners: higher scores first, then smaller ids."""

    def __init__(self, owners: int, size: int) -> None:
        self.size = size
        self.scores = np.full((owners, size), _LEAST)
        self.ids = np.zeros((owners, size), np.int64)
        self.full = np.zeros((owners, size), bool)

    def merge(self, scores: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        s, i, f = (np.concatenate(x, 1) for x in ((self.scores, scores), (self.ids, ids), (self.full, full)))
        order = np.lexsort((i, ~s, ~f), axis=1)[:, : self.size]
        self.scores, self.ids, self.full = (np.take_along_axis(x, order, 1) for x in (s, i, f))


def _best_first(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Places of each row's columns: allowed ones first, then by score; columns come in order of id."""
    return np.argsort(~np.where(allowed, scores, _LEAST), axis=1, kind="stable")


class Positives:
    """Of each anchor: its best rows of the same label."""

    schema = "anchor long, id long, score long"

    def __init__(self, anchors: pa.RecordBatch, most: int, *_: int) -> None:
        self.anchors, self.q = anchors, vectors(anchors["q"])
        self.ids, self.labels = (anchors[c].to_numpy() for c in ("id", "label"))
        self.heaps = Heaps(len(self.ids), most)

    def add(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        scores = _product(self.q, q)
        allowed = (self.labels[:, None] == labels) & (self.ids[:, None] != ids)
        first = _best_first(scores, allowed)[:, : self.heaps.size]
        self.heaps.merge(np.take_along_axis(scores, first, 1), ids[first], np.take_along_axis(allowed, first, 1))

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.heaps.full)
        return pa.RecordBatch.from_arrays([pa.array(self.anchors["row"].to_numpy()[row]), pa.array(self.heaps.ids[row, place]), pa.array(self.heaps.scores[row, place])], ["anchor", "id", "score"])


class Windows:
    """Of each anchor and positive: the best rows of other labels from low to high per cent of the positive's score."""

    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"

    def __init__(self, anchors: pa.RecordBatch, most: int, low: int, high: int) -> None:
        self.anchors, self.q = anchors, vectors(anchors["q"])
        self.ids, self.labels = (anchors[c].to_numpy() for c in ("id", "label"))
        lists = anchors["positives"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.positive, p = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "score"))
        self.score = p
        # Whole hundreds and the rest apart, so that nothing overflows; the lower end is rounded up.
        self.least = low * (p // 100) - (-low * (p % 100)) // 100
        self.most = high * (p // 100) + high * (p % 100) // 100
        self.heaps = Heaps(len(self.owner), most)

    def add(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        scores = _product(self.q, q)
        allowed = self.labels[:, None] != labels
        order = _best_first(scores, allowed)
        scores, allowed = np.take_along_axis(scores, order, 1), np.take_along_axis(allowed, order, 1)
        n, size = len(ids), self.heaps.size
        # Each window begins behind the scores above it.
        for places in np.array_split(np.arange(len(self.owner)), max(1, len(self.owner) // 2048)):
            own = self.owner[places]
            begin = (allowed[own] & (scores[own] > self.most[places, None])).sum(1)
            at = begin[:, None] + np.arange(size)
            inside = at < n
            at = np.minimum(at, n - 1)
            s = scores[own[:, None], at]
            fits = inside & allowed[own[:, None], at] & (s >= self.least[places, None]) & (s <= self.most[places, None])
            part = Heaps(0, size)
            part.scores, part.ids, part.full = (x[places] for x in (self.heaps.scores, self.heaps.ids, self.heaps.full))
            part.merge(s, ids[order[own[:, None], at]], fits)
            self.heaps.scores[places], self.heaps.ids[places], self.heaps.full[places] = part.scores, part.ids, part.full

    def found(self) -> pa.RecordBatch:
        window, place = np.nonzero(self.heaps.full)
        own = self.owner[window]
        columns = [self.anchors["row"].to_numpy()[own], self.ids[own], self.place[window].astype(np.int32), self.positive[window], self.score[window], self.heaps.ids[window, place], self.heaps.scores[window, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.strip().split(" ")[0] for c in self.schema.split(",")])


def _cells(keeper: type, *options: int) -> Callable:
    """Rows that come sorted by cell, anchors first: what keeper finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, keeps = None, [], None

        def tiles(part: pa.RecordBatch) -> None:
            ids, labels, q = part["id"].to_numpy(), part["label"].to_numpy(), vectors(part["q"])
            for a in range(0, len(ids), TILE):
                by_id = a + np.argsort(ids[a : a + TILE], kind="stable")
                keeps.add(ids[by_id], labels[by_id], q[by_id])

        for batch in batches:
            where = np.stack([batch[c].to_numpy() for c in ("block", "slice", "kind")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1)])) if len(where) else []
            for a, b in zip(starts, [*starts[1:], len(where)], strict=True):
                block, part_of, kind = where[a].tolist()
                if (block, part_of) != cell:
                    if keeps:
                        yield keeps.found()
                    cell, anchors, keeps = (block, part_of), [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    anchors.append(part)
                elif anchors:
                    keeps = keeps or keeper(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0], *options)
                    tiles(part)
        if keeps:
            yield keeps.found()

    return run


def hard_negatives(rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id and label (integers), vector; anchor says which rows are anchors. low and high
    are per cents of the positive's score.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for c in ("id", "label"):
        if rows.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise TypeError(f"{c} must be an integer column")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    q = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    known = stored(whole.select(F.col("id").cast("long"), F.col("label").cast("long"), q.alias("q"), anchor.alias("anchor"), F.monotonically_increasing_id().alias("row")))
    count = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    blocks = max(1, math.ceil(count["a"] / ANCHORS))
    slices = max(1, math.ceil(count["n"] / ROWS), math.ceil(parts / blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    digest = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    candidates = known.withColumn("slice", digest(slices, 1)).withColumn("block", every(blocks)).withColumn("kind", F.lit(1))

    def best(anchors: DataFrame, keeper: type, most: int) -> DataFrame:
        placed = anchors.withColumn("block", digest(blocks, 2)).withColumn("slice", every(slices)).withColumn("kind", F.lit(0))
        columns = ["block", "slice", "kind", "row", "id", "label", "q", *(c for c in anchors.columns if c == "positives")]
        cells = placed.unionByName(candidates, allowMissingColumns=True).select(*columns)
        return cells.repartition(max(parts, blocks * slices), "block", "slice").sortWithinPartitions("block", "slice", "kind").mapInArrow(_cells(keeper, most, low, high), keeper.schema)

    own = known.where("anchor")
    order = [F.desc("score"), "id"]
    first = best(own, Positives, positives).withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    lists = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives")).withColumnRenamed("anchor", "row")
    found = best(stored(own.join(lists, "row")), Windows, negatives)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings: every fiftieth id is an anchor; every seventh row bears a wrong label."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0)


ORACLE = """
with known as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.id as anchor_id, a.label = b.label as same, b.id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
    from known a join known b on a.id <> b.id where a.id % 50 = 0),
positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
negatives as (
    select p.*, s.id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
    from positives p join scored s on s.anchor_id = p.anchor_id and not same
        and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""
