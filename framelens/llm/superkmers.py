"""Substring dedup of words by super-k-mer partitioning.

A k-mer is a window of ``LENGTH`` consecutive words of one document. Consecutive windows
that share a minimiser (see ``runs``) travel as one packed string of words to the bucket of
the minimiser, where sorting (multikey quicksort, two words at a time) brings equal windows
together and gives the least document of each exactly.

A minimiser with more than ``MOST`` different runs has several buckets: its windows are dealt
among them by a digest of the window, and a run travels to each with the stretch of words
that the bucket's windows need. Equal windows share a bucket, where they are sorted like all
others, so no bucket holds much more than ``MOST`` runs' worth of windows whose words differ.

Each word covered by a window whose word sequence also starts in a document with a smaller
id is removed; windows are judged on the input.

Defined results: null text has no words; texts with fewer than ``LENGTH`` words keep
everything; a null id is smaller than all others; rows with equal ids do not remove each
other's words; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import runs as R
from framelens.llm.common import WORD, joined, stored

LENGTH = 50
MINIMISER = 10
#: Different runs of a minimiser that share one bucket.
MOST = 8192
REMEMBERED = 1_000_000
_WORDS = re.compile(WORD)
#: Python's split() also parts at these; texts with them are split by the pattern.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text) if _OTHER_SPACES.search(text) else text.split()


class Codes(dict):
    """A 64-bit digest of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return code


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = Codes()
    for batch in batches:
        tids, docs = batch["_tid"].to_numpy(), batch["doc_id"].to_numpy()
        texts = batch["text"].tolist()
        for part in R.chunks([len(t) // 6 for t in texts]):
            words = [words_of(t) for t in texts[part]]
            lengths = np.array([len(w) for w in words])
            flat = np.fromiter((code for w in words for code in map(codes.__getitem__, w)), np.uint64, int(lengths.sum()))
            own, start, n, at, key, rh = R.scan(flat, lengths, LENGTH, MINIMISER)
            yield pd.DataFrame({"doc_id": docs[part][own], "_tid": tids[part][own], "start": start, "n": n, "at": at, "key": key, "rh": rh, "sha": None})
            shas = [sha256(" ".join(w).encode("utf-8", "surrogatepass")).hexdigest() for w in words]
            yield pd.DataFrame({"doc_id": docs[part], "_tid": tids[part], "start": -1, "n": lengths, "at": 0, "key": 0, "rh": 0, "sha": shas})


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = Codes()
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["runs"], strict=True):
            words = words_of(text)
            for run in wanted:
                start, n, key, rh, w, buckets = run["start"], run["n"], run["key"], run["rh"], run["w"], run["buckets"]
                own = words[start : start + n + LENGTH - 1]
                if buckets <= 1:
                    rows.append((key, 0, rh, 0, n, w, " ".join(own).encode("utf-8", "surrogatepass"), None))
                    continue
                at = np.arange(n)
                of = R.Digests(np.fromiter(map(codes.__getitem__, own), np.uint64, len(own))).of(at, at + LENGTH) % np.uint64(buckets)
                for bucket in np.unique(of):
                    mine = np.flatnonzero(of == bucket)
                    a, b = int(mine[0]), int(mine[-1]) + 1
                    rows.append((key, int(bucket), rh, a, b - a, w, " ".join(own[a : b + LENGTH - 1]).encode("utf-8", "surrogatepass"), np.packbits(of[a:b] == bucket).tobytes()))
        yield pd.DataFrame(rows, columns=["key", "bucket", "rh", "first", "n", "w", "data", "mine"])


def _bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in R.whole_groups(batches, "place"):
        sizes = rows["n"].to_numpy().astype(np.int64)
        group = np.unique(rows["place"].to_numpy(), return_inverse=True)[1]
        numbers: dict[bytes, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for data in rows["data"] for w in data.split(b" ")), np.uint64)
        begins = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
        firsts = np.cumsum(sizes) - sizes
        mine = np.concatenate([np.ones(n, bool) if m is None else np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for n, m in zip(sizes, rows["mine"], strict=True)])
        windows = np.flatnonzero(mine)
        at = (np.repeat(begins - firsts, sizes) + np.arange(sizes.sum()))[windows]
        same, classes = R.multikey(np.repeat(group, sizes)[windows], lambda items, c: (flat[at[items] + 2 * c] << np.uint64(32)) | flat[at[items] + 2 * c + 1], LENGTH // 2)
        flags = np.zeros(len(mine), bool)
        if len(same):
            docs = np.repeat(rows["w"].to_numpy(), sizes)[windows][same]
            edges = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
            least = np.repeat(np.minimum.reduceat(docs, edges), np.diff(np.append(edges, len(same))))
            flags[windows[same]] = docs > least
        some = np.flatnonzero(np.logical_or.reduceat(flags, firsts))
        bits = [R.packed(flags[firsts[i] : firsts[i] + sizes[i]]) for i in some]
        yield pd.DataFrame({"key": rows["key"].to_numpy()[some], "rh": rows["rh"].to_numpy()[some], "first": rows["first"].to_numpy()[some], "n": sizes[some], "bits": pd.Series(bits, dtype=object)})


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, tid, text, found in zip(batch["doc_id"], batch["_tid"], batch["text"], batch["found"], strict=True):
            words = words_of(text)
            gone = R.covered(R.chosen(len(words) - LENGTH + 1, found), LENGTH)
            kept = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((doc_id, tid, int(gone.sum()), sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "_tid", "n_removed", "_left"])


def remove_seen_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    own = R.identified(docs)
    scanned = stored(own.mapInPandas(_scan, f"{R.RUNS}, sha string"))
    found, total = R.repeated(scanned.where("start >= 0").drop("sha"), across=True)
    kept = stored(own.join(found.select("doc_id", "_tid").distinct(), ["doc_id", "_tid"], "left_semi"))
    runs = R.distinct_runs(found, F.min("doc_id"))
    different = stored(runs.groupBy("key").agg(F.count(F.lit(1)).alias("_different")).withColumn("buckets", F.ceil(F.col("_different") / F.lit(MOST)).cast("int")))
    dealt = joined(runs, different, ["key"], "_different", total)
    sent = R.spelt(kept, dealt, _strings, "key long, bucket int, rh long, first int, n int, w long, data binary, mine binary", "buckets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.withColumn("place", F.xxhash64("key", "bucket"))
    bits = sent.repartition(parts, "place").sortWithinPartitions("place").mapInPandas(_bucket, "key long, rh long, first int, n int, bits string")
    marked = R.marks(found, runs, bits, full=F.col("doc_id") > F.col("w"), single=F.col("doc_id") > F.col("lo"), total=total)
    done = kept.dropDuplicates(["doc_id", "_tid"]).join(marked, ["doc_id", "_tid"]).mapInPandas(_apply, "doc_id long, _tid long, n_removed long, _left string")
    whole = scanned.where("start < 0").select("doc_id", "_tid", F.col("n").cast("long").alias("n_words"), "sha")
    return whole.join(done, ["doc_id", "_tid"], "left").select(R.given(docs), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_left", "sha").alias("kept_sha256"))
