"""Quality: a second-order factorisation machine over words, structure and metadata.

A text's features are its distinct words in lower case, hashed to ``WORD_BUCKETS`` (each
with the value 1 / sqrt(number of distinct words)), ``STRUCTURE`` statistics of the whole
text and its stated length (metadata). The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose last term has all pairwise interactions in time linear in the features.

The model is fitted by mini-batch Adagrad on a bounded sample of the labelled rows: at most
``max_fit`` of each label, those with the smallest digest of the id. Every whole text is
scored.

Defined results: a null text is empty, has no words and is scored on its structure alone;
null labels are not used; of documents that share a labelled id one is learnt from; a null n_chars is replaced by the text's length; without labels of both kinds the score
is the share of the label 1 (0.5 without labels); an empty table gives an empty table; rows
that repeat an id or a text are scored alike; labels, lang, source and doc_id are never
inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import bounded_sample, crc_fold

WORD_BUCKETS = 1 << 15
FACTORS = 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows of each label that the machine is fitted on, at most.
MAX_FIT = 4000
EPOCHS = 8
STATISTICS = 17


class WordBuckets(dict):
    """Bucket of each word, remembered; cleared when it has a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        bucket = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


def structure(text: str, words: list[str], distinct: int, n_chars: float) -> list[float]:
    """The structure and metadata statistics, each about 0 to 3."""
    n, size = len(words), len(text)
    chars = size + 20.0
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    # One pass counts all characters; those beyond Latin-1 count together as "?".
    counts = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), np.uint8), minlength=256)
    upper, digits = int(counts[65:91].sum() + counts[0xC0:0xDF].sum()), int(counts[48:58].sum())
    same = sum(map(str.__eq__, words, words[1:]))
    # Characters of runs of one word, with a space between each two.
    runs = ((len(w), sum(1 for _ in run)) for w, run in groupby(words)) if same else ()
    repeated = sum((length + 1) * times - 1 for length, times in runs if times > 1)
    return [
        np.log1p(n) / 4,
        (size - n + 60.0) / (n + 10.0) / 6,
        *(10 * np.sqrt(counts[ord(c)] / chars) / 3 for c in "#*$%|!"),
        3 * upper / chars,
        3 * digits / chars,
        3 * (counts[44] + counts[46]) / (n + 5.0),
        1.0 - distinct / (n + 1.0),
        1.0 - len(set(full)) / (len(full) + 1.0),
        2 * repeated / chars,
        2 * same / (n + 5.0),
        np.log1p(len(full)) / 3,
        np.log1p(max(n_chars, 0.0)) / 6,
    ]


class Encoder:
    """Turns a text into (word ids, statistics)."""

    def __init__(self) -> None:
        self.buckets = WordBuckets()

    def __call__(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        distinct = set(words)
        ids = np.unique(np.fromiter(map(self.buckets.__getitem__, {w.lower() for w in distinct}), np.int32))
        own = float(len(text)) if n_chars is None or n_chars != n_chars else float(n_chars)
        return ids, np.array(structure(text, words, len(distinct), own), np.float32)


class Machine:
    """Weights of the hashed words, then of the statistics; w0 apart."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    def score(self, ids: np.ndarray, stats: np.ndarray) -> float:
        value = 1.0 / np.sqrt(max(len(ids), 1))
        words = self.v[ids]
        rest = self.v[WORD_BUCKETS:]
        total = words.sum(0) * value + stats @ rest
        squares = (words * words).sum(0) * value * value + (stats * stats) @ (rest * rest)
        z = self.w0 + self.w[ids].sum() * value + stats @ self.w[WORD_BUCKETS:] + 0.5 * (total * total - squares).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, batch: int = 64, seed: int = 42) -> Machine:
    """Mini-batch Adagrad on the logistic loss; the two labels weigh alike."""
    size = WORD_BUCKETS + STATISTICS
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    own = np.arange(WORD_BUCKETS, size)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = order[start : start + batch]
            ids = np.concatenate([np.concatenate([rows[k][0], own]) for k in chosen])
            x = np.concatenate([np.concatenate([np.full(len(rows[k][0]), 1.0 / np.sqrt(max(len(rows[k][0]), 1))), rows[k][1]]) for k in chosen])
            lengths = np.array([len(rows[k][0]) + STATISTICS for k in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts)
            pairs = 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(1)
            z = w0 + np.add.reduceat(w[ids] * x, starts) + pairs
            slope = weights[chosen] * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, lengths) * x
            dv = each[:, None] * (np.repeat(total, lengths, 0) - vx)
            used, at = np.unique(ids, return_inverse=True)
            sum_w = np.bincount(at, each, len(used)) + l2 * w[used]
            sum_v = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(FACTORS)], 1) + l2 * v[used]
            gw[used] += sum_w**2
            gv[used] += sum_v**2
            g0 += slope.sum() ** 2
            w[used] -= rate * sum_w / np.sqrt(gw[used])
            v[used] -= rate * 0.2 * sum_v / np.sqrt(gv[used])
            w0 -= rate * slope.sum() / np.sqrt(g0)
    return Machine(w0, w, v)


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encode = Encoder()
    for batch in batches:
        rows = [encode(t, n) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
        yield pd.DataFrame({"_id": batch["_id"], "label": batch["label"], "ids": [a.astype(np.int32).tobytes() for a, _ in rows], "stats": [b.tobytes() for _, b in rows]})


def sample_of(docs: DataFrame, labels: DataFrame, max_fit: int) -> list:
    """label, ids, stats of one row per sampled id: at most 2 * max_fit rows, however often ids repeat."""
    chosen = bounded_sample(labels, max_fit)
    sized = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    rows = sized.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most 2 * max_fit ids
    encoded = rows.select(F.col("_id").cast("string").alias("_id"), "label", "text", "n_chars").mapInPandas(_encoded, "_id string, label int, ids binary, stats binary")
    once = encoded.groupBy("_id").agg(F.min(F.struct("label", "ids", "stats")).alias("row"))  # combined before the shuffle
    return sorted(once.select("row.*").collect(), key=lambda r: (r["label"], r["ids"], r["stats"]))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Machine:
    """docs: doc_id, text, n_chars. labels: _id, label (others than 0 and 1 are not used)."""
    sample = sample_of(docs, labels, max_fit)
    known = np.array([r["label"] for r in sample], float)
    if not len(known) or known.min() == known.max():
        level = 0.0 if not len(known) else 30.0 if known[0] else -30.0
        return Machine(level, np.zeros(WORD_BUCKETS + STATISTICS), np.zeros((WORD_BUCKETS + STATISTICS, FACTORS)))
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["stats"], np.float32)) for r in sample], known)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # size fixed by WORD_BUCKETS

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own, encode = Machine(*shared.value), Encoder()
        for texts, sizes in batches:
            yield pd.Series([own.score(*encode(t, n)) for t, n in zip(texts, sizes, strict=True)], dtype="float64")

    out = docs.withColumn("score", scored("text", F.col("n_chars").cast("double")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    own = own.where((crc_fold("_id", FOLDS) != HELD_OUT) & F.col("label").isNotNull())
    docs = docs.select("doc_id", "text", "n_chars")
    out = score(docs, fit(docs, own))
    return out.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
