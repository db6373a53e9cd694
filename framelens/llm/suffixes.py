"""Substring dedup of bytes by a sparse suffix array.

Suffixes start at minimisers (see ``runs``), so that any two equal strings of 200 bytes hold
suffixes at the same place; suffixes whose first 40 bytes never repeat are left out before
anything travels. A suffix travels with the bytes around it, once for all equal stretches.

1. Splitters are sampled from the suffixes and range-partition them by their leading bytes.
   Suffixes with the same first 40 bytes stay together if they are no more than ``BUCKET``,
   else splitters of up to 200 bytes cut them, so that no bucket grows with such a group.
2. A bucket sorts its suffixes by multikey quicksort, and likewise the bytes before them,
   backwards, and takes the lengths on which neighbours agree. A string of 200 bytes that
   begins b bytes before a suffix is a repeat if another suffix agrees with it on 200 - b
   bytes ahead and b bytes back: if both are in one class of either order at these lengths.
3. Buckets are compared across their boundaries: strings whose bytes ahead are the beginning
   of a splitter within a group may have equals in other buckets. These leave the bucket, by
   splitter and bytes back, and are counted by an aggregation on the bytes themselves.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes keep everything;
repeated rows repeat each other, so both lose all their repeated strings; an empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import runs as R
from framelens.llm.common import joined, sampled, stored

LENGTH = 200
LEADING = 40
#: Suffixes of a bucket, about, and of a group that is not cut.
BUCKET = 50_000
#: The digest of a splitter before all suffixes that begin with its bytes.
BEFORE = -(1 << 63)
#: A fixed random code for every byte.
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [_raw(t) for t in batch["text"]]
        docs, tids = batch["doc_id"].to_numpy(), batch["_tid"].to_numpy()
        for part in R.chunks([len(r) for r in raw]):
            some = raw[part]
            lengths = np.array([len(r) for r in some])
            own, start, n, at, key, rh = R.scan(CODES[np.frombuffer(b"".join(some), np.uint8)], lengths, LENGTH, LEADING)
            yield pd.DataFrame({"doc_id": docs[part][own], "_tid": tids[part][own], "start": start, "n": n, "at": at, "key": key, "rh": rh, "sha": None})
            yield pd.DataFrame({"doc_id": docs[part], "_tid": tids[part], "start": -1, "n": lengths, "at": 0, "key": 0, "rh": 0, "sha": [sha256(r).hexdigest() for r in some]})


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["runs"], strict=True):
            raw = _raw(text)
            rows += [(run["key"], run["rh"], run["n"], run["at"], run["w"], raw[run["start"] : run["start"] + run["n"] + LENGTH - 1]) for run in wanted]
        yield pd.DataFrame(rows, columns=["key", "rh", "n", "at", "w", "data"])


def _agreement(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row in the order of all, bytes on which each in that order agrees with the one before)."""
    lengths = np.array([len(r) for r in rows])
    table = np.zeros((len(rows), width), np.uint8)
    table[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    places = np.arange(4)

    def column(items: np.ndarray, c: int) -> np.ndarray:
        # Four bytes, each one higher than it is, so that the end of a row comes before any byte.
        part = table[items, 4 * c : 4 * c + 4].astype(np.uint64) + (4 * c + places < lengths[items, None])
        return (part << np.array([48, 32, 16, 0], np.uint64)).sum(1, dtype=np.uint64)

    order = R.order_of(column, len(rows), width // 4)
    differs = table[order[1:]] != table[order[:-1]]
    agree = np.where(differs.any(1), differs.argmax(1), width)
    agree = np.minimum(agree, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    return rank, np.concatenate([[0], agree])


def _common(a: bytes, b: bytes) -> int:
    """Bytes on which a and b agree."""
    size = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else size


def _bucket(cuts: list[tuple[bytes, int]]):
    """The verdicts of buckets between cuts, and the strings to compare across them (cut >= 0)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in R.whole_groups(batches, "place"):
            n, at, w = (rows[c].to_numpy().astype(np.int64) for c in ("n", "at", "w"))
            data, keys, hashes = rows["data"].tolist(), rows["key"].to_numpy(), rows["rh"].to_numpy()
            ahead = [d[a:] for d, a in zip(data, at, strict=True)]
            back = [d[:a][::-1] for d, a in zip(data, at, strict=True)]
            # Strings that reach no further ahead than this may have equals behind a cut.
            near = np.zeros(len(rows), np.int64)
            for i, (own, bucket) in enumerate(zip(ahead, rows["bucket"], strict=True)):
                near[i] = max((_common(own, cuts[c][0]) for c in (bucket - 1, bucket) if 0 <= c < len(cuts) and cuts[c][1] != BEFORE and cuts[c][0][:LEADING] == own[:LEADING]), default=0)
            rank_a, agree_a = _agreement(ahead, LENGTH)
            rank_b, agree_b = _agreement(back, LENGTH - LEADING)
            firsts = np.cumsum(n) - n
            flags = np.zeros(int(n.sum()), bool)
            out: list[tuple] = []
            for b in range(int(at.max()) + 1):
                items = np.flatnonzero((b <= at) & (b > at - n))
                crossing = near[items] >= LENGTH - b
                for i in items[crossing].tolist():
                    cut = bisect_left(cuts, (ahead[i][: LENGTH - b],))
                    out.append((int(keys[i]), int(hashes[i]), int(at[i] - b), int(n[i]), None, cut, back[i][:b], int(w[i])))
                items = items[~crossing]
                if len(items):
                    pair = np.cumsum(agree_a < LENGTH - b)[rank_a[items]] * (len(rows) + 1) + np.cumsum(agree_b < b)[rank_b[items]]
                    _, of = np.unique(pair, return_inverse=True)
                    flags[firsts[items] + at[items] - b] = np.bincount(of, w[items])[of] > 1
            some = np.flatnonzero(np.logical_or.reduceat(flags, firsts))
            out += [(int(keys[i]), int(hashes[i]), 0, int(n[i]), R.packed(flags[firsts[i] : firsts[i] + n[i]]), -1, None, 0) for i in some]
            yield pd.DataFrame(out, columns=["key", "rh", "first", "n", "bits", "cut", "back", "w"])

    return compare


def _compared(sent: DataFrame) -> DataFrame:
    """key, rh, first, n, bits of the repeated strings in the suffixes of sent."""
    spark = sent.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffix = F.expr(f"substring(data, at + 1, {LENGTH})")
    buckets = max(parts, sent.count() // BUCKET)
    sample, every = sampled(sent.select(suffix.alias("suffix"), "rh"), buckets)
    sample = [(bytes(a), h) for a, h in sample]
    groups = Counter(a[:LEADING] for a, _ in sample)
    picked = {sample[len(sample) * i // buckets] for i in range(1, buckets)} if sample else set()
    cuts = sorted({(a, h) if groups[a[:LEADING]] * every > BUCKET else (a[:LEADING], BEFORE) for a, h in picked})
    shared = spark.sparkContext.broadcast(cuts)  # one of LENGTH bytes for every bucket

    @F.pandas_udf("int")
    def bucket_of(suffixes: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, (a, h)) for a, h in zip(suffixes, hashes, strict=True)], dtype="int32")

    placed = sent.withColumn("bucket", bucket_of(suffix, "rh")).withColumn("place", F.xxhash64("bucket", "key"))
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "place")
    found = stored(dealt.mapInPandas(_bucket(cuts), "key long, rh long, first int, n int, bits string, cut int, back binary, w long"))
    inside = found.where("cut < 0").select("key", "rh", "first", "n", "bits")
    across = found.where("cut >= 0").withColumn("length", F.length("back"))
    same = across.groupBy("cut", "length", "back").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("_times"))
    same = stored(same.where("all > 1").drop("all").withColumn("hit", F.lit(True)))
    hits = joined(across.select("key", "rh", "first", "n", "cut", "length", "back"), same, ["cut", "length", "back"], "_times", across.count())
    one = F.lit(R.packed(np.ones(1, bool)))
    return inside.unionByName(hits.select("key", "rh", "first", F.lit(1).alias("n"), one.alias("bits")))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, tid, text, found in zip(batch["doc_id"], batch["_tid"], batch["text"], batch["found"], strict=True):
            raw = np.frombuffer(_raw(text), np.uint8)
            gone = R.covered(R.chosen(len(raw) - LENGTH + 1, found), LENGTH)
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
            out.append((doc_id, tid, int(gone.sum()), spans, sha256(raw[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "_tid", "n_removed", "n_spans", "_left"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    own = R.identified(docs)
    scanned = stored(own.mapInPandas(_scan, f"{R.RUNS}, sha string"))
    found, total = R.repeated(scanned.where("start >= 0").drop("sha"), across=False)
    kept = stored(own.join(found.select("doc_id", "_tid").distinct(), ["doc_id", "_tid"], "left_semi"))
    runs = R.distinct_runs(found, F.count(F.lit(1)))
    sent = R.spelt(kept, runs, _strings, "key long, rh long, n int, at int, w long, data binary")
    marked = R.marks(found, runs, _compared(sent), full=F.col("w") > 1, single=F.lit(True), total=total)
    done = kept.dropDuplicates(["doc_id", "_tid"]).join(marked, ["doc_id", "_tid"]).mapInPandas(_apply, "doc_id long, _tid long, n_removed long, n_spans long, _left string")
    whole = scanned.where("start < 0").select("doc_id", "_tid", F.col("n").cast("long").alias("n_bytes"), "sha")
    nothing = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(done, ["doc_id", "_tid"], "left").select(R.given(docs), "n_bytes", nothing("n_removed"), nothing("n_spans"), F.coalesce("_left", "sha").alias("kept_sha256"))
