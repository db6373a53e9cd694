"""A small awkward corpus and brute-force versions of the operators."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("score", T.StringType()), T.StructField("size", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("label", T.StringType()),
])


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9))) for _ in range(n))


def corpus(seed=1, count=60):
    """Rows with copies, near copies, shared passages, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(count)]
    texts[3] = texts[2]
    texts[5] = texts[4].replace(" ", "  ", 1)
    for k in range(10, 18):
        texts[k] = f"{prose(rng, k)} {passage}\n{prose(rng, 9)}"
    base = prose(rng, 150)
    for k in range(20, 30):
        words = base.split()
        words[rng.randrange(len(words))] = prose(rng, 1)
        texts[k] = " ".join(words)
    texts[31], texts[32], texts[33], texts[34] = None, "", " \n\t ", "one"
    texts[35] = prose(rng, 6000)
    texts[36] = "aa " * 300
    texts[37] = "Ünïcödé ßtraße " * 40 + "日本語 テスト"
    texts[38] = "x" * 1000
    texts[39] = f"{passage} {passage}"
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""), None, 1, 2, 3, "s", "f", "l") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
