"""Repeated windows of k units (bytes or words), found through minimisers.

Every window of k units has a minimiser: among its m-unit grams the one with the smallest
digest, the leftmost of equals. Equal windows have equal minimisers, so a window can only
repeat if its minimiser does. Consecutive windows with the same minimiser form a run (a
super-k-mer): k - 1 + n units for n windows. The steps:

1. ``scan``: every whole text gives its runs as (row, start, n, minimiser, digest of the
   run). Texts stay where they are.
2. ``repeated``: minimisers are counted with partial sums; runs with an unrepeated one are
   done.
3. Equal runs are one from here on, with a weight (how often, or the least document), so
   thousands of copies cost as much as one (``distinct_runs``). Where a minimiser has a single
   run there is nothing to compare, and that run's weight decides. Where it has several, one
   row per different run travels with its text (``spelt``) and is sorted and compared unit
   by unit, as ``suffixes`` and ``superkmers`` say.
4. ``marks`` carries the verdicts back to every copy. Minimisers and runs that very many rows
   share are broadcast instead of shuffled (``common.joined``).

Rows are known by their id and a 64-bit digest of their text (_tid); rows that are equal in
both share their verdict.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import joined, stored

#: Units that a scan or a bucket works on at once.
CHUNK = 1 << 18
BUCKET_BYTES = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 31) - 1)
RUNS = "doc_id long, _tid long, start int, n int, at int, key long, rh long"


@lru_cache(maxsize=4)
def _powers(size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b & 0xFFFFFFFFFFFFFFFF, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


class Digests:
    """Digests of any stretch of a sequence of codes, each in constant time."""

    def __init__(self, codes: np.ndarray, base: int = _BASE) -> None:
        # Powers for whole chunks, and for longer sequences at the next power of two.
        self.up, self.down = _powers(max(CHUNK * 2, 1 << int(len(codes)).bit_length()), base)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def scan(codes: np.ndarray, lengths: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Runs of texts laid end to end: (text, start in the text, windows, place of the minimiser in the run, minimiser, digest)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(codes) < k:
        return none
    digests = Digests(codes)
    grams = len(codes) - m + 1
    at = np.arange(grams)
    # np.uint64 sums wrap; slices instead of fancy indexing keep this cheap.
    h = mixed((digests.sums[m:] - digests.sums[:grams]) * digests.down[:grams] + np.uint64(m))
    least = sliding_min((h & ~_PLACE) | at.astype(np.uint64), k - m + 1) & _PLACE
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.flatnonzero(text[: len(codes) - k + 1] == text[k - 1 :])
    if not len(valid):
        return none
    places = least[valid].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    start = valid[first]
    n = np.diff(np.append(first, len(valid)))
    own = text[start]
    return own, start - (ends - lengths)[own], n, places[first] - start, h[places[first]].view(np.int64), digests.of(start, start + n + k - 1).view(np.int64)


def chunks(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= CHUNK:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


#: The number that stands for a null id; it comes before all others.
NULL_ID = -(1 << 63)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (as long, null as NULL_ID), _tid (a digest of the text), text (null as empty)."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer column")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("_tid"), text.alias("text"))


def given(docs: DataFrame, column: str = "doc_id") -> Column:
    """The id as it was in docs."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).cast(docs.schema["doc_id"].dataType).alias(column)


def repeated(runs: DataFrame, across: bool) -> tuple[DataFrame, int]:
    """Runs whose minimiser repeats (across: in different documents), with multi (several different runs have it) and lo (the least document); how many."""
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("_times"), F.min("rh").alias("a"), F.max("rh").alias("b"), *([F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")] if across else []))
    keys = stored(keys.where("lo < hi" if across else "_times > 1").select("key", (F.col("a") != F.col("b")).alias("multi"), *(["lo"] if across else []), "_times"))
    total = keys.agg(F.sum("_times")).first()[0] or 0
    return stored(joined(runs, keys, ["key"], "_times", total)), total


def distinct_runs(found: DataFrame, weigh: Column) -> DataFrame:
    """One row per different run of the minimisers that have several: key, rh, w, n, one place (rep), _times."""
    several = found.where("multi").groupBy("key", "rh")
    return stored(several.agg(weigh.alias("w"), F.first("n").alias("n"), F.min(F.struct("doc_id", "_tid", "start", "at")).alias("rep"), F.count(F.lit(1)).alias("_times")))


def spelt(kept: DataFrame, runs: DataFrame, strings: Callable, schema: str, *more: str) -> DataFrame:
    """strings of the texts that hold the runs' places, each text with the list of its runs."""
    places = F.collect_list(F.struct("rep.start", "n", "rep.at", "key", "rh", "w", *more)).alias("runs")
    wanted = runs.groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep._tid").alias("_tid")).agg(places)
    return stored(kept.dropDuplicates(["doc_id", "_tid"]).join(wanted, ["doc_id", "_tid"]).mapInPandas(strings, schema))


def multikey(group: np.ndarray, column: Callable[[np.ndarray, int], np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over fixed-width items within groups: (items that have an equal, class of each).

    column(items, c) gives character c of the items as integers. A class of items that agree
    so far is split by the next character; a class whose next characters are all equal moves
    on as it is, and an item alone in its class is done. Items come out by class.
    """
    order = np.argsort(group, kind="stable")
    classes = group[order]
    for c in range(columns):
        starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        alone = np.repeat(sizes == 1, sizes)
        order, sizes = order[~alone], sizes[sizes > 1]
        if not len(order):
            return order, order
        classes = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        value = column(order, c)
        differs = np.logical_or.reduceat(value != np.repeat(value[starts], sizes), starts)
        if differs.any():
            inside = np.flatnonzero(np.repeat(differs, sizes))
            sub = np.lexsort((value[inside], classes[inside]))
            order[inside], value[inside] = order[inside[sub]], value[inside[sub]]
        new = np.concatenate([[True], (classes[1:] != classes[:-1]) | (value[1:] != value[:-1])])
        classes = np.cumsum(new) - 1
    sizes = np.bincount(classes) if len(classes) else np.zeros(0, np.int64)
    paired = np.repeat(sizes > 1, sizes)
    return order[paired], classes[paired]


def order_of(column: Callable[[np.ndarray, int], np.ndarray], count: int, columns: int) -> np.ndarray:
    """The items in ascending order by multikey quicksort: only items that agree so far are split by their next character."""
    order, starts = np.arange(count), np.zeros(count, bool)
    starts[:1] = True
    for c in range(columns):
        alone = starts & np.append(starts[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        classes = np.cumsum(starts)[at]
        value = column(order[at], c)
        sub = np.lexsort((value, classes))
        order[at], value = order[at[sub]], value[sub]
        starts[at[1:]] |= (value[1:] != value[:-1]) | (classes[1:] != classes[:-1])
    return order


def marks(found: DataFrame, runs: DataFrame, bits: DataFrame, full: Column, single: Column, total: int) -> DataFrame:
    """doc_id, _tid and found (set of start, n, bits in base64; null: all windows) of the rows that have windows to remove.

    runs: from distinct_runs; bits: key, rh, first, n, bits of the windows that were found by
    comparing. full decides from (doc_id, w) whether all windows of a run go, single the same
    where the run's minimiser has no other run (from doc_id, lo).
    """
    alone = found.where(~F.col("multi") & single).select("doc_id", "_tid", "start", "n", F.lit(None).cast("string").alias("bits"))
    parts = bits.groupBy("key", "rh").agg(F.collect_list(F.struct("first", "n", "bits")).alias("parts"))
    verdicts = stored(runs.select("key", "rh", "w", "_times").join(parts, ["key", "rh"], "left"))
    judged = joined(found.where("multi").select("key", "rh", "doc_id", "_tid", "start", "n"), verdicts, ["key", "rh"], "_times", total)
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("n"), F.lit(None).cast("string").alias("bits")))
    judged = judged.select("doc_id", "_tid", "start", F.explode(F.when(full, whole).otherwise(F.col("parts"))).alias("p"))
    judged = judged.select("doc_id", "_tid", (F.col("start") + F.col("p.first")).alias("start"), "p.n", "p.bits")
    return alone.unionByName(judged).groupBy("doc_id", "_tid").agg(F.collect_set(F.struct("start", "n", "bits")).alias("found"))


def packed(flags: np.ndarray) -> str:
    return base64.b64encode(np.packbits(flags).tobytes()).decode()


def whole_groups(batches: Iterator[pd.DataFrame], by: str = "key") -> Iterator[pd.DataFrame]:
    """Rows that come sorted with equal keys together, in pieces that never part a key."""
    waiting: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        for start in range(0, len(batch), 2000):
            part = batch.iloc[start : start + 2000]
            waiting.append(part)
            size += int(part["data"].str.len().sum())
            if size >= BUCKET_BYTES:
                rows = pd.concat(waiting)
                keys = rows[by].to_numpy()
                whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                if whole:
                    yield rows.iloc[:whole]
                waiting, size = [rows.iloc[whole:]], int(rows["data"].iloc[whole:].str.len().sum())
    if waiting and sum(map(len, waiting)):
        yield pd.concat(waiting)


def chosen(length: int, runs: list) -> np.ndarray:
    """Flags of the windows to remove among length of them, from (start, n, bits)."""
    flags = np.zeros(max(length, 0), bool)
    for run in runs:
        start, n, bits = run["start"], run["n"], run["bits"]
        flags[start : start + n] |= True if bits is None else np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8), count=n).astype(bool)
    return flags


def covered(flags: np.ndarray, k: int) -> np.ndarray:
    """Units covered by the flagged windows of k units."""
    edge = np.zeros(len(flags) + k, np.int32)
    edge[: len(flags)] += flags
    edge[k:] -= flags
    return np.cumsum(edge)[:-1] > 0
