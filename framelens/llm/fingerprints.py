"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) and the chain of the next two content words behind
it; a fingerprint is the set of a text's signatures, as sorted 32-bit digests in base64. Two
fingerprints are alike by Jaccard similarity, pruned: sets whose lengths bound it below the
threshold are not compared.

``fingerprints_with_edits`` sets every text beside the next document's in ascending id. The
documents are dealt into runs by sampled splitters of id and text digest, so that equal and
null ids are spread as well, and sorted within each run; a run is compared as it streams by.
The first document of a run also travels to the run before it. Only splitters and the first
keys of runs (at most ``MAX_RUNS``) pass the driver. The result does not depend on them.

``similar_fingerprints`` finds all pairs of different fingerprints at or above a threshold:
lengths are partitioned so that similar sets lie in the same or neighbouring partitions, and
within those an inverted index on the rarest signatures of each set finds the candidates.

Defined results: null text is empty and its fingerprint is the empty string; empty sets are
alike (1.0); texts with fewer than ``LEAST`` signatures also have the pairs of neighbouring
words, and single words themselves; null ids come first; rows with equal ids are in order of a
digest of their text, then of the text (null as empty); the only document of a table is its own next; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import free, splitters

CHAIN = 2
LEAST = 4
ROWS_PER_RUN = 1000
MAX_RUNS = 50_000
THRESHOLD = 0.8
REMEMBERED = 1_000_000
#: Anchors: common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or
    she that the their they this to was were which who will with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er
    es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von war wie wird zu
    au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur mais ne
    nous ou par pas pour que qui sa se ses son sont sur un une vous
    al como con de del el ella en era es esta este ha la las lo los más me mi no o para pero por
    que se ser si sin sobre son su sus también un una y ya
    """.split()
)
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Words(dict):
    """Code of each part between spaces: twice a digest of the word, plus one for anchors; 0 without a word."""

    def __missing__(self, part: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        word = part.lower().strip(_STRIP)
        digest = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2
        code = self[part] = (digest << 1 | (word in ANCHORS)) or 2 if word else 0
        return code


def signatures(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text."""
    codes = np.fromiter(map(words.__getitem__, (text or "").split()), np.int64)
    codes = codes[codes != 0].astype(np.uint64)
    anchor = (codes & np.uint64(1)).astype(bool)
    content = codes[~anchor]
    # Content words before each anchor; the chain is the content words from there on.
    behind = np.cumsum(~anchor)[anchor]
    fits = behind + CHAIN <= len(content)
    at = behind[fits]
    found = [_mix(codes[anchor][fits], content[at], content[at + 1])]
    if len(found[0]) < LEAST:
        found.append(_mix(np.uint64(0), codes[:-1], codes[1:]) if len(codes) > 1 else _mix(np.uint64(0), codes, codes))
    return np.unique(np.concatenate(found))


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * _A) ^ ((b + _C) * _B)
        h = (h ^ (h >> np.uint64(29))) * _C + c * _A
        h ^= h >> np.uint64(32)
        return ((h * _B) >> np.uint64(32)).astype(np.uint32)


def encoded(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of sorted sets, 0.0 without comparing them where their lengths keep it below threshold."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < threshold * large:
        return 0.0
    both = small + large - len(np.unique(np.concatenate([a, b])))
    return both / (small + large - both)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint and its set length n_signatures (columns of those names are replaced)."""

    @F.pandas_udf("fingerprint string, n_signatures int")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for texts in batches:
            found = [signatures(t, words) for t in texts]
            yield pd.DataFrame({"fingerprint": [encoded(x) for x in found], "n_signatures": [len(x) for x in found]})

    kept = [c for c in docs.columns if c not in ("fingerprint", "n_signatures")]
    own = free("_made", docs.columns)
    return docs.withColumn(own, made(text_col)).select(*kept, f"{own}.*")


def _in_runs(docs: DataFrame) -> DataFrame:
    """_known, _id, _digest, text, _run, _ahead: the rows of each run, and as _ahead those that open the next run."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    # In pairs with _known, ids need not be null, so that no batch turns them into doubles.
    none = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
    rows = docs.select(F.col("doc_id").isNotNull().cast("int").alias("_known"), F.coalesce("doc_id", none).alias("_id"), F.xxhash64(text).alias("_digest"), text.alias("text"))
    keys = rows.select("_known", "_id", "_digest")
    cuts = splitters(keys, max(1, min(MAX_RUNS, keys.count() // ROWS_PER_RUN)))
    shared = spark.sparkContext.broadcast(cuts)  # at most MAX_RUNS

    @F.pandas_udf("int")
    def run_of(known: pd.Series, ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, key) for key in zip(known, ids, digests, strict=True)], dtype="int32")

    run = run_of("_known", "_id", "_digest") if cuts else F.lit(0)
    firsts = keys.withColumn("_run", run).groupBy("_run").agg(F.min(F.struct("_known", "_id", "_digest")).alias("_first")).orderBy("_run").collect()  # at most MAX_RUNS
    before = [(*r["_first"], firsts[k - 1]["_run"]) for k, r in enumerate(firsts)]
    ahead = spark.createDataFrame(before, f"_known int, _id {kind.simpleString()}, _digest long, _to int")
    joined = rows.withColumn("_run", run).join(F.broadcast(ahead), ["_known", "_id", "_digest"], "left")  # one row per run
    here = F.struct(F.col("_run").alias("_run"), F.lit(0).alias("_ahead"))
    there = F.struct(F.col("_to").alias("_run"), F.lit(1).alias("_ahead"))
    places = F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))
    return joined.withColumn("_place", F.explode(places)).select(*rows.columns, "_place.*")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the first as many characters of the next
    document's text.
    """

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        run, waiting = None, None  # waiting: id, text and signatures of the last document
        for batch in batches:
            rows = []
            for doc_id, text, own_run, is_ahead in zip(batch["doc_id"], batch["text"], batch["_run"], batch["_ahead"], strict=True):
                if own_run != run:
                    run, waiting = own_run, None
                elif waiting is None:
                    continue  # a further row that opens the next run
                found = signatures(text, words)
                if waiting is not None:
                    last_id, last, last_found = waiting
                    half = len(last) // 2
                    edited = last[: len(last) - half] + text[:half]
                    edited_found = signatures(edited, words)
                    rows.append((last_id, len(last), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(last_found), encoded(edited_found), pruned_jaccard(last_found, edited_found), pruned_jaccard(last_found, found)))
                waiting = None if is_ahead else (doc_id, text, found)
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType
    dealt = _in_runs(docs).repartition("_run").sortWithinPartitions("_run", "_ahead", "_known", "_id", "_digest", "text")
    dealt = dealt.select(F.when(F.col("_known") == 1, F.col("_id").cast("string")).alias("doc_id"), "text", "_run", "_ahead")
    out = dealt.mapInPandas(compared, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", out["doc_id"].cast(kind))


def similar_fingerprints(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left, right, similarity: pairs of different fingerprints, each by its smallest doc_id.

    prints: doc_id and fingerprint. Documents with equal fingerprints are one class, known by
    its smallest doc_id, so copies are never paired with each other.
    """
    classes = prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))

    @F.pandas_udf("array<long>")
    def spelt(values: pd.Series) -> pd.Series:
        return pd.Series([decoded(v).astype(np.int64) for v in values])

    sets = classes.withColumn("_set", spelt("fingerprint")).withColumn("_size", F.size("_set"))
    width = -np.log(threshold)
    sets = sets.withColumn("_part", F.floor(F.log("_size") / width + 1e-9))
    terms = sets.select("doc_id", "_size", "_part", F.explode("_set").alias("_term"))
    counts = terms.groupBy("_term").agg(F.count(F.lit(1)).alias("_in"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_in", "_term"))
    # Similar sets share one of their rarest size - ceil(threshold * size) + 1 signatures.
    prefix = terms.join(counts, "_term").withColumn("_rank", rank).where(F.col("_rank") <= F.col("_size") - F.ceil(F.col("_size") * threshold - 1e-9) + 1)
    left = prefix.select("_term", F.col("doc_id").alias("left"), F.col("_size").alias("_a"), "_part")
    right = prefix.select("_term", F.col("doc_id").alias("right"), F.col("_size").alias("_b"), F.explode(F.array(F.col("_part"), F.col("_part") + 1)).alias("_part"))
    near = (F.least("_a", "_b") >= threshold * F.greatest("_a", "_b") - 1e-9) & ((F.col("_a") > F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("left") < F.col("right"))))
    pairs = left.join(right, ["_term", "_part"]).where(near).select("left", "right").distinct()
    a, b = sets.select(F.col("doc_id").alias("left"), F.col("_set").alias("_x")), sets.select(F.col("doc_id").alias("right"), F.col("_set").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    out = pairs.join(a, "left").join(b, "right").withColumn("similarity", both / (F.size("_x") + F.size("_y") - both))
    return out.where(F.col("similarity") >= threshold).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "similarity")
