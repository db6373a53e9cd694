"""Toxicity: a character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are the character n-grams (4 to 6, over words in lower case with a space on either
side) that a text holds, each once, hashed to 2^22. An n-gram lies within one word and its
two spaces, so a text's features are those of its distinct words, and words are remembered.
A feature is scaled by the log ratio of the smoothed shares of toxic and of clean texts that
hold it; a text's scaled features are a vector of length one, so that long texts are scored
like short ones. A logistic regression is fitted on these by mini-batch descent, over every
feature that any counted text holds.

The classifier learns from a bounded sample of the labelled rows, those with the smallest
digest of the id: ratios from at most ``MAX_COUNT`` ids of each label (counted by Spark with
partial sums), coefficients from at most ``MAX_FIT`` of those. How far the shares are smoothed is
chosen within that sample, by the loss of either half under the model of the other. Every
whole text is scored.

Defined results: a null text is empty and is scored by the intercept alone; labels of null
are not used; of documents that share a labelled id one is learnt from; without labels of
both kinds every score is the share of toxic labels (0.0 without labels); an empty table
gives an empty table; rows that repeat an id or a text are scored alike; ids, languages,
sources and labels are never part of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import bounded_sample, crc_fold, stored

BITS = 22
SIZES = (4, 5, 6)
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled ids of each label that the linear model is fitted on, at most.
MAX_FIT = 3000
#: Labelled ids of each label that the log-count ratios are taken from, at most.
MAX_COUNT = 12_000
#: Words whose n-grams a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 60
#: Words of a text that are turned into n-grams at once.
PIECE = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of words, by word, with repeats."""
    parts = [f" {w} " for w in words]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    rows, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    rolled = codes
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * _STEP + codes[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(of[: len(codes) - n + 1] == of[n - 1 :])
            rows.append(of[at])
            ids.append(((rolled[at] * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    found, features = np.concatenate(rows), np.concatenate(ids)
    order = np.argsort(found, kind="stable")
    return found[order], features[order]


class Features:
    """The sorted distinct features of whole texts."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = list(set((text or "").lower().split()))
        if len(words) > PIECE:
            seen = np.zeros(1 << BITS, bool)
            for start in range(0, len(words), PIECE):
                seen[grams(words[start : start + PIECE])[1]] = True
            return np.flatnonzero(seen).astype(np.int32)
        found = [self.known[w] for w in words if w in self.known]
        new = [w for w in words if w not in self.known]
        if new:
            rows, ids = grams(new)
            found.append(ids)
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
            ends = np.searchsorted(rows, np.arange(len(new) + 1))
            self.known.update((w, ids[a:b].copy()) for w, a, b in zip(new, ends, ends[1:], strict=False) if len(w) <= LONGEST)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """The features that were counted, their ratios and coefficients, and the intercept."""

    ids: np.ndarray
    ratios: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def scorer(self):
        """Features of a text -> score."""
        weights, squares = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        weights[self.ids] = self.coefficients * self.ratios
        squares[self.ids] = self.ratios * self.ratios

        def of(found: np.ndarray) -> float:
            length = float(squares[found].sum(dtype=np.float64)) ** 0.5
            z = self.intercept + (float(weights[found].sum(dtype=np.float64)) / length if length else 0.0)
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

        return of


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold each feature, by half of the sample and label."""
    counts, features = np.zeros((4, 1 << BITS), np.int32), Features()
    for batch in batches:
        for text, label, half in zip(batch["text"], batch["label"], batch["half"], strict=True):
            counts[2 * int(half) + int(label)][features(text)] += 1
    used = np.flatnonzero(counts.any(0))
    yield pd.DataFrame({"feature": used.astype(np.int32)} | {c: counts[k, used] for k, c in enumerate(COUNTS)})


#: Columns of counts: half and label.
COUNTS = ("clean0", "toxic0", "clean1", "toxic1")
#: What is added to both shares of a feature, so that n-grams which few texts hold have ratios near 0 whichever label is rarer: one of these.
SMOOTHINGS = (0.001, 0.003, 0.01, 0.03, 0.1)
#: Rows of each label and half that a smoothing is judged by, at most.
MAX_CHOICE = 600


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, smoothing: float) -> np.ndarray:
    return np.log(toxic / n_toxic + smoothing) - np.log(clean / n_clean + smoothing)


def log_loss(found: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, w: np.ndarray, b: float) -> float:
    """Mean negative log likelihood of rows, the two labels weighing alike."""
    z = np.array([(w[f] * ratios[f]).sum() / max(float((ratios[f] ** 2).sum()), 1e-12) ** 0.5 + b for f in found])
    loss = np.logaddexp(0, np.where(labels == 1, -z, z))
    return float(sum(loss[labels == k].mean() for k in (0, 1)))


def chosen_smoothing(counts: np.ndarray, totals: np.ndarray, found: list[np.ndarray], labels: np.ndarray, half: np.ndarray) -> float:
    """The smoothing whose models of one half have the least loss on the other. counts, totals: by half and label."""
    if (totals == 0).any() or any(not ((half == h) & (labels == k)).any() for h in (0, 1) for k in (0, 1)):
        return SMOOTHINGS[len(SMOOTHINGS) // 2]  # a half without a label can't judge
    few = {h: np.concatenate([np.flatnonzero((half == h) & (labels == k))[:MAX_CHOICE] for k in (0, 1)]) for h in (0, 1)}
    losses = []
    for smoothing in SMOOTHINGS:
        loss = 0.0
        for h in (0, 1):
            ratios = log_count_ratios(counts[2 * h], counts[2 * h + 1], totals[2 * h], totals[2 * h + 1], smoothing)
            w, b = logistic([found[i] for i in few[h]], labels[few[h]], ratios)
            loss += log_loss([found[i] for i in few[1 - h]], labels[few[1 - h]], ratios, w, b)
        losses.append(loss)
    return SMOOTHINGS[int(np.argmin(losses))]


def logistic(found: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, epochs: int = 10, rate: float = 20.0, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic regression on scaled features, the two labels weighing alike.

    Row i has the values ratios[f] over their length at the features f = found[i]. Only one
    batch of rows is expanded at a time. With rows of length one a step of 4 is the largest
    that cannot overshoot on a single row; in a batch of 32 each row's is less than one.
    """
    rng = np.random.default_rng(seed)
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    scale = np.array([1.0 / max(float((ratios[f] ** 2).sum()), 1e-12) ** 0.5 for f in found])
    w, b = np.zeros(len(ratios)), 0.0
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for start in range(0, len(found), batch):
            chosen = order[start : start + batch]
            lengths = np.array([len(found[k]) for k in chosen])
            ids = np.concatenate([found[k] for k in chosen])
            row = np.repeat(np.arange(len(chosen)), lengths)
            x = ratios[ids] * scale[chosen][row]
            z = np.bincount(row, w[ids] * x, len(chosen)) + b
            slope = weights[chosen] * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            used, at = np.unique(ids, return_inverse=True)
            w[used] -= rate * np.bincount(at, slope[row] * x, len(used))
            b -= 0.25 * rate * float(slope.sum())
    return w, b


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = Features()
    for batch in batches:
        yield pd.DataFrame({"label": batch["label"], "half": batch["half"], "ids": [features(t).tobytes() for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_count: int = MAX_COUNT) -> Model:
    """docs: doc_id, text. labels: _id, label (others than 0 and 1 are not used)."""
    chosen = bounded_sample(labels, max_count)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most 2 * max_count ids
    # One row per id, however often ids repeat: combined before the shuffle.
    once = rows.groupBy("_id").agg(F.min(F.struct("label", "_rank", F.coalesce("text", F.lit("")).alias("text"))).alias("row"))
    half = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)).cast("int")
    labelled = stored(once.select("row.text", F.col("row.label").cast("int").alias("label"), F.col("row._rank").alias("_rank"), half.alias("half")))
    sizes = {(r["half"], r["label"]): r["n"] for r in labelled.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = np.array([sizes.get((h, k), 0) for h in (0, 1) for k in (0, 1)])
    clean, toxic = int(totals[0] + totals[2]), int(totals[1] + totals[3])
    if not clean or not toxic:
        return Model(np.zeros(0, np.int32), np.zeros(0), np.zeros(0), 30.0 if toxic else -30.0)
    counted = labelled.mapInPandas(_count, f"feature int, {', '.join(f'{c} int' for c in COUNTS)}").groupBy("feature").agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS]).toArrow()  # at most 2**BITS rows
    order = np.argsort(counted["feature"].to_numpy())
    ids = counted["feature"].to_numpy()[order]
    counts = np.stack([counted[c].to_numpy()[order] for c in COUNTS])
    sample = labelled.where(F.col("_rank") <= max_fit).mapInPandas(_encoded, "label int, half int, ids binary").toArrow()  # at most 2 * max_fit rows
    rows = sorted(zip(sample["label"].to_pylist(), sample["ids"].to_pylist(), sample["half"].to_pylist(), strict=True))
    del sample, counted
    # Features are numbered among those counted, so that the fit is as wide as they are many.
    found = [np.searchsorted(ids, np.frombuffer(i, np.int32)).astype(np.int32) for _, i, _ in rows]
    kinds = np.array([k for k, _, _ in rows], float)
    smoothing = chosen_smoothing(counts, totals, found, kinds, np.array([h for _, _, h in rows]))
    ratios = log_count_ratios(counts[0] + counts[2], counts[1] + counts[3], clean, toxic, smoothing)
    w, b = logistic(found, kinds, ratios)
    return Model(ids, ratios, w, b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (columns of those names are replaced)."""
    # At most 2**BITS features of 12 bytes.
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.ratios.astype(np.float32), model.coefficients.astype(np.float32), model.intercept))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, of = Features(), Model(*shared.value).scorer()
        for batch in batches:
            yield pd.Series([of(features(t)) for t in batch], dtype="float64")

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """_id and label of the folds that are not held out."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("label"))
    return own.where((crc_fold("_id", FOLDS) != HELD_OUT) & F.col("label").isNotNull())


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, training_labels(labels, "toxic")))
    return out.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
